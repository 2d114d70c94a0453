"""Queries of catalogues, mails, owners and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import rules as R
from cardloom.operators import portfolio as P
from cardloom.operators.lifecycle import ended_products
from cardloom.operators.settle import spread
from cardloom.plans.register import query
from cardloom.sources.tables import CLOCK, view


def _case(spark, sf_dir, table: str, *columns: str):
    """A table with columns of SQL that both engines read alike."""
    return view(spark, sf_dir, table).selectExpr(*columns)


@query("""WITH x AS (SELECT id, CASE id % 4 WHEN 0 THEN 'visa' WHEN 1 THEN 'rupay' WHEN 3 THEN 'mastercard' END AS a, CASE id % 5 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'americanexpress' END AS b, CASE WHEN id % 7 = 0 THEN 'americanexpress' END AS c FROM card_catalog)
SELECT id, CASE WHEN NOT k THEN coalesce(a, b, c) END AS network, k AS conflict FROM (SELECT *, coalesce(a <> b, false) OR coalesce(coalesce(a, b) <> c, false) AS k FROM x)""")
def str10_effective_network(spark, sf_dir):
    """A card's network from its field, its name and its issuer, with conflicts flagged."""
    rows = _case(spark, sf_dir, "card_catalog", "id", "network", "card_name || CASE id % 5 WHEN 0 THEN ' Visa' WHEN 1 THEN ' Master Card' WHEN 2 THEN ' (AMEX)' ELSE ' visage' END AS name", "CASE WHEN id % 7 = 0 THEN ' American Express' ELSE bank END AS issuer")
    network, conflict = R.effective_network(F.col("network"), F.col("name"), F.col("issuer"))
    return rows.select("id", network.alias("network"), conflict.alias("conflict"))


_PART = "CASE page_id % 5 WHEN 0 THEN 'a%20b+c' WHEN 1 THEN 'x%2' WHEN 2 THEN 'caf%C3%A9' WHEN 3 THEN '%zz' ELSE url END || CAST(page_id AS STRING)"


@query(f"SELECT page_id, CASE WHEN NOT regexp_matches(v, '%($|.$|[^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f])') THEN url_decode(replace(v, '+', ' ')) END AS decoded FROM (SELECT page_id, {_PART} AS v FROM pages)")
def str16_decoded(spark, sf_dir):
    """Components of urls read strictly."""
    return _case(spark, sf_dir, "pages", "page_id", f"{_PART} AS v").select("page_id", R.decoded(F.col("v")).alias("decoded"))


@query("SELECT benefit_id, 'card-benefit-v2:' || card_id || ':' || sha256(CAST(id AS VARCHAR)) AS scoped_key FROM card_benefit_mapping")
def str28_scoped_key(spark, sf_dir):
    return view(spark, sf_dir, "card_benefit_mapping").select("benefit_id", R.scoped_key(F.col("card_id"), F.sha2(F.col("id").cast("string"), 256)).alias("scoped_key"))


@query("""SELECT p_partkey, coalesce(length(trim(p_brand)) BETWEEN 2 AND 120 AND k % 3 < 2 AND k % 5 < 4 AND k % 7 < 6 AND k % 11 < 10 AND (k % 4 <> 0 OR k % 8 = 0) AND k % 13 <> 0, false) AS eligible FROM (SELECT *, p_partkey AS k FROM part)""")
def flt15_may_enqueue(spark, sf_dir):
    """Requests that may be queued: issuer, url, hash, type, issue and identity of a card agree."""
    rows = _case(
        spark, sf_dir, "part", "p_partkey", "CASE WHEN p_partkey % 3 < 2 THEN upper(p_brand) || ' ' ELSE 'other' END AS issuer", "'HTTPS://Bank.example/cards/p' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 5 < 4 THEN '/?utm_source=x#top' ELSE '/other' END AS url",
        "sha2('https://bank.example/cards/p' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 7 < 6 THEN '' ELSE 'x' END, 256) AS h", "p_brand AS bank", "'https://bank.example/cards/p' || CAST(p_partkey AS STRING) AS card_url",
        "CASE WHEN p_partkey % 11 < 10 THEN ' Credit' ELSE 'debit' END AS card_type", "p_partkey % 4 = 0 AS gone", "p_partkey % 8 = 0 AS held", "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE false END AS unresolved",
    )
    return rows.select("p_partkey", R.may_enqueue(*map(F.col, ("issuer", "url", "h", "bank", "card_url", "card_type", "gone", "held", "unresolved"))).alias("eligible"))


@query("SELECT p_partkey, p_partkey % 4 < 2 AND length(p_name) <= 100 AS sound FROM part")
def arr3_sound_names(spark, sf_dir):
    names = F.expr("CASE p_partkey % 4 WHEN 0 THEN array(p_name) WHEN 1 THEN array(p_name, 'x') WHEN 2 THEN array(p_name, ' ') ELSE array(p_name, 'x', 'y') END")
    return view(spark, sf_dir, "part").select("p_partkey", R.sound_names(names).alias("sound"))


_NUMBER = "CASE p_partkey % 6 WHEN 0 THEN CAST(p_retailprice AS STRING) WHEN 1 THEN '0.0000' || CAST(1000 + p_size AS STRING) WHEN 2 THEN '90071992547409' || CAST(10 + p_size % 90 AS STRING) WHEN 3 THEN CAST(p_size AS STRING) || 'e3' WHEN 4 THEN '-0' ELSE CAST(p_size AS STRING) || 'e-9' END"


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN 9007199254740900 + 10 + p_size % 90 <= 9007199254740991 WHEN 3 THEN true WHEN 4 THEN true ELSE p_size = 0 END AS safe FROM part")
def jsn3_safe_numbers(spark, sf_dir):
    """JSON whose numbers doubles hold; digits in its texts do not count."""
    made = F.concat(F.lit('{"t":"1e999 \\\\" 0.12345678","list":[1,{"n":'), F.expr(_NUMBER), F.lit("}],\"b\":true}"))
    return view(spark, sf_dir, "part").select("p_partkey", R.safe_numbers(made).alias("safe"))


@query("SELECT p_partkey, contains(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), 'brushed') OR contains(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), 'brushed') AS found FROM part")
def flt12_label_match(spark, sf_dir):
    labels = F.array("p_name", F.lit(None).cast("string"), "p_type")
    return view(spark, sf_dir, "part").select("p_partkey", R.label_matches(labels, F.lit(" BRUSHED!")).alias("found"))


@query("""SELECT page_id, CASE WHEN k < 4 THEN sha256('https://bank.example' || CASE k WHEN 0 THEN '/p' || page_id WHEN 1 THEN '' WHEN 2 THEN '/?file=a%20b-' || page_id % 1000 ELSE '/p' || page_id || '?version=2&locale=en' END) END AS identity FROM (SELECT page_id, page_id % 10 AS k FROM pages)""")
def str18_source_identity(spark, sf_dir):
    """Digests of sources; none for what might give a secret away."""
    tail = """CASE page_id % 10 WHEN 0 THEN '/p' || CAST(page_id AS STRING) || '/' WHEN 1 THEN '/' WHEN 2 THEN '?file=a%20b-' || CAST(page_id % 1000 AS STRING) WHEN 3 THEN '/p' || CAST(page_id AS STRING) || '?version=2&locale=en' WHEN 4 THEN '/p?token=1'
      WHEN 5 THEN '/p?file=access_token' WHEN 6 THEN '/p?file=a%2540b' WHEN 7 THEN '/p?version=1234567890' WHEN 8 THEN '/p?file' ELSE '/p#top' END"""
    return _case(spark, sf_dir, "pages", "page_id", f"'HTTPS://Bank.example:443' || {tail} AS u").select("page_id", R.source_identity(F.col("u")).alias("identity"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '<main><h1>' || p_name || ' card</h1></main>' ELSE '<body> <main>else</main>' || CASE WHEN p_partkey % 3 = 1 THEN ' ' ELSE '<main>' || p_type || '</main>' END || '</body>' END AS part FROM part""")
def str20_product_part(spark, sf_dir):
    """Pages without header and the like; the main section of the product where there is one."""
    html = F.expr("'<body><nav>a<nav>b</nav></nav><main>else</main>' || CASE p_partkey % 3 WHEN 0 THEN '<main><h1>' || p_name || ' card</h1></main>' WHEN 1 THEN '<div class=x role=\"banner\">' || p_name || '</div>' ELSE '<main>' || p_type || '</main>' END || '</body>'")
    return view(spark, sf_dir, "part").select("p_partkey", R.product_part(html, F.col("p_name")).alias("part"))


_SAID = "CASE c_custkey % 8 WHEN 0 THEN 'An offer for ' || replace(lower(c_mktsegment), ' ', '') || ' gets 5%' WHEN 1 THEN 'Points to cardholders.' WHEN 2 THEN 'This card is for asha rao' WHEN 3 THEN 'for 12 days.' WHEN 4 THEN 'access for members will end' WHEN 5 THEN 'made for Regalia Gold!' WHEN 6 THEN 'to fuel surcharge, only' ELSE 'no cue' END"


@query("SELECT c_custkey, c_custkey % 8 IN (0, 2) AS person FROM customer")
def str24_names_person(spark, sf_dir):
    """Texts that speak of a person, and not of a card."""
    return _case(spark, sf_dir, "customer", "c_custkey", f"{_SAID} AS t").select("c_custkey", R.names_person(F.col("t"), F.array(F.lit("regalia gold"))).alias("person"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[{"k":' || k || '}]' WHEN 1 THEN '[{"k":' || k || '}]' WHEN 2 THEN '{"k":{"v":' || k || '}}' ELSE 'none' END AS json FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def str26_healed(spark, sf_dir):
    """JSON in answers that were cut."""
    made = """CASE event_id % 4 WHEN 0 THEN 'Here: [{"k":' || get_json_object(props, '$.k') || '}]' WHEN 1 THEN '[{"k":' || get_json_object(props, '$.k') || '}, {"k":' WHEN 2 THEN ' {"k":{"v":' || get_json_object(props, '$.k') ELSE ' none ' END AS t"""
    return _case(spark, sf_dir, "events", "event_id", made).select("event_id", R.healed(F.col("t")).alias("json"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'travel:lounge_access:domestic' WHEN 1 THEN 'insurance:insurance_cover:lost_card' WHEN 2 THEN 'cashback:cashback:' || CASE WHEN p_size % 2 = 0 THEN 'grocery' ELSE 'fuel' END WHEN 3 THEN 'rewards:reward_points:general' WHEN 4 THEN 'entertainment:bogo:movie_tickets' ELSE 'golf:benefit:general' END AS subject FROM part""")
def dom22_offer_subject(spark, sf_dir):
    """What offers are about."""
    said = """CASE p_partkey % 6 WHEN 0 THEN 'Visits across India' WHEN 1 THEN 'cover for a Lost Card' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN '5% on groceries and fuel' ELSE '5% on FUEL and groceries, movies' END WHEN 3 THEN 'points on online/offline spends except fuel' ELSE 'films' END AS t"""
    kinds = "CASE p_partkey % 6 WHEN 0 THEN 'travel' WHEN 1 THEN 'insurance' WHEN 2 THEN 'cashback' WHEN 3 THEN 'points' WHEN 4 THEN 'entertainment' ELSE 'golf' END AS c", "CASE p_partkey % 6 WHEN 0 THEN 'lounge_access' WHEN 1 THEN 'insurance_cover' WHEN 2 THEN 'cashback' WHEN 3 THEN 'reward_points' WHEN 4 THEN 'bogo' END AS k"
    return _case(spark, sf_dir, "part", "p_partkey", said, *kinds).select("p_partkey", R.offer_subject(F.col("c"), F.col("k"), F.col("t")).alias("subject"))


@query("""SELECT o_orderkey, CAST(d AS VARCHAR) AS statement_date, CAST(coalesce(due, d + 20) AS VARCHAR) AS due_date FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) - 2 ELSE DATE '2001-08-15' END AS d, CASE WHEN o_orderkey % 5 = 0 THEN DATE '2001-09-09' END AS due FROM orders)""")
def dt15_statement_dates(spark, sf_dir):
    """Dates of statements by three fallbacks."""
    rows = _case(spark, sf_dir, "orders", "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS m", "CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) - 2 END AS f", "DATE '2001-08-15' AS r", "CASE WHEN o_orderkey % 5 = 0 THEN DATE '2001-09-09' END AS due")
    day, due = R.statement_dates(*map(F.col, ("m", "f", "r", "due")))
    return rows.select("o_orderkey", day.cast("string").alias("statement_date"), due.cast("string").alias("due_date"))


@query(f"""SELECT count(*) AS transactions, sum(amount) AS total FROM transactions WHERE transaction_date >= TIMESTAMP '{CLOCK}' - INTERVAL 60 DAY AND transaction_date <= TIMESTAMP '{CLOCK}'""")
def dt14_default_period(spark, sf_dir):
    """What the last sixty days hold, the period where none is asked for."""
    now = F.lit(CLOCK).cast("timestamp_ntz")
    rows = view(spark, sf_dir, "transactions").where(F.col("transaction_date").between(now - F.expr("INTERVAL '60' DAY"), now))
    return rows.agg(F.count("*").alias("transactions"), F.sum("amount").alias("total"))


@query("""SELECT event_id, '{"backfill":"' || CASE WHEN event_id % 2 = 0 THEN 'food' ELSE 'fuel' END || '","k":"' || CAST(json_extract(props, '$.k') AS BIGINT) || '"}' AS metadata FROM events""")
def snk5_merged_metadata(spark, sf_dir):
    """Metadata with a member put in, whatever it held."""
    old = "'{\"k\":\"' || get_json_object(props, '$.k') || '\"' || CASE WHEN event_id % 3 = 0 THEN ',\"backfill\":\"old\"}' ELSE '}' END AS j"
    rows = _case(spark, sf_dir, "events", "event_id", old)
    return rows.select("event_id", R.merged_json(F.col("j"), F.create_map(F.lit("backfill"), F.when(F.col("event_id") % 2 == 0, F.lit("food")).otherwise(F.lit("fuel")))).alias("metadata"))


@query("""WITH x AS (SELECT case_id, baseline_pass AS b, candidate_pass AS c, case_id % 11 <> 0 AS rubric, case_id % 13 <> 0 AS sch, severe, CASE case_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'candidate' END AS w, (case_id % 10) / 10.0 AS conf FROM eval_results),
y AS (SELECT *, rubric AND sch AND c AND w IS NOT NULL AND conf >= 0.7 AS sure FROM x)
SELECT case_id, c AND NOT (sure AND w = 'baseline') AS passed, (b AND NOT c) OR (sure AND w = 'baseline') AS regression, b AND NOT c AND severe AS severe_regression, NOT (rubric AND sch AND c AND sure AND w = 'candidate') AS requires_review FROM (SELECT * REPLACE (coalesce(w, 'none') AS w) FROM y)""")
def dom37_recommendation_verdict(spark, sf_dir):
    """Verdicts on recommendations, a judge of enough confidence heard."""
    rows = _case(spark, sf_dir, "eval_results", "case_id", "baseline_pass AS b", "candidate_pass AS c", "case_id % 11 <> 0 AS rubric", "case_id % 13 <> 0 AS sch", "severe", "CASE case_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'candidate' END AS w", "(case_id % 10) / 10.0D AS conf")
    return rows.select("case_id", *[c.alias(n) for n, c in R.recommendation_verdict(*map(F.col, ("b", "c", "rubric", "sch", "severe", "w", "conf"))).items()])


_MAIL = "SELECT c_custkey AS mail_id, c_custkey AS user_id, 'hdfc bank ltd' AS bank, CASE c_custkey % 4 WHEN 0 THEN 'st_' || CAST(c_custkey AS STRING) || 'x.pdf' WHEN 1 THEN CAST(1000 + c_custkey % 9000 AS STRING) || '-Aug.pdf' ELSE NULL END AS filename, 'Your ' || CASE WHEN c_custkey % 3 = 0 THEN 'Regalia Gold Club' ELSE 'Gold' END || ' statement' AS subject FROM customer"


@query("""SELECT c_custkey AS mail_id, CASE WHEN c_custkey % 4 = 1 OR (c_custkey % 4 = 0 AND CAST(c_custkey AS VARCHAR) = CAST(1000 + c_custkey % 9000 AS VARCHAR)) THEN c_custkey * 10 WHEN c_custkey % 3 = 0 THEN c_custkey * 10 + 1 END AS card_id FROM customer""")
def str36_card_of_mail(spark, sf_dir):
    """Which of the user's cards a mail is about."""
    mails = spark.sql(_MAIL.replace("FROM customer", "FROM {customer}"), customer=view(spark, sf_dir, "customer"))
    cards = view(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_custkey AS k", "explode(array(0, 1, 2)) AS n").selectExpr(
        "user_id", "k * 10 + n AS card_id", "CASE n WHEN 0 THEN CAST(1000 + k % 9000 AS STRING) WHEN 1 THEN ' 12' ELSE CAST(1000 + k % 9000 AS STRING) END AS last_four", "CASE n WHEN 2 THEN 'ICICI' ELSE 'HDFC' END AS bank", "CASE n WHEN 1 THEN 'Regalia Gold' ELSE 'Gold' END AS card_name")
    return P.card_of_mail(mails, cards)


@query("""SELECT count(*) FILTER (WHERE o = 0) AS "succeeded", count(*) FILTER (WHERE o = 1) AS "needsPassword", count(*) FILTER (WHERE o = 2) AS "needsCardAssignment", count(*) FILTER (WHERE o = 3) AS "discoveryQueued", count(*) FILTER (WHERE o = 4) AS failed, count(*) FILTER (WHERE o > 4) AS other, count(*) AS mails FROM (SELECT (event_id * 7 + user_id) % 7 AS o FROM events)""")
def agg31_outcome_tally(spark, sf_dir):
    outcome = F.get(F.array(*[F.lit(o) for o in P.OUTCOMES], F.lit("odd"), F.lit(None)), ((F.col("event_id") * 7 + F.col("user_id")) % 7).cast("int"))
    return P.outcome_tally(view(spark, sf_dir, "events").select(outcome.alias("outcome")))


@query("SELECT m.id, m.card_id, m.benefit_id, b.title, c.card_name FROM card_benefit_mapping m JOIN benefits b ON b.id = m.benefit_id JOIN card_catalog c ON c.id = m.card_id")
def jn3_offered_benefits(spark, sf_dir):
    """Mappings with both their sides."""
    benefits = view(spark, sf_dir, "benefits").select(F.col("id").alias("benefit_id"), "title")
    cards = view(spark, sf_dir, "card_catalog").select(F.col("id").alias("card_id"), "card_name")
    return P.offered_benefits(view(spark, sf_dir, "card_benefit_mapping").select("id", "card_id", "benefit_id"), benefits, cards).select("id", "card_id", "benefit_id", "title", "card_name")


@query(f"""SELECT m.id, m.card_id, b.category, (b.valid_from IS NULL OR b.valid_from <= DATE '{CLOCK[:10]}') AND (b.valid_until IS NULL OR b.valid_until >= DATE '{CLOCK[:10]}') AS holds FROM card_benefit_mapping m JOIN benefits b ON b.id = m.benefit_id""")
def jn2_benefits_at_clock(spark, sf_dir):
    """Mapped benefits, and whether they hold at the clock given."""
    day = F.lit(CLOCK[:10]).cast("date")
    b = view(spark, sf_dir, "benefits").select(F.col("id").alias("benefit_id"), "category", ((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= day))).alias("holds"))
    return view(spark, sf_dir, "card_benefit_mapping").join(b, "benefit_id").select("id", "card_id", "category", "holds")


@query("""WITH o AS (SELECT DISTINCT user_id, catalog_card_id AS card_id FROM user_cards WHERE is_active), f AS (SELECT m.card_id, m.benefit_id FROM card_benefit_mapping m JOIN benefits b ON b.id = m.benefit_id JOIN card_catalog c ON c.id = m.card_id),
s AS (SELECT u.user_id, u.catalog_card_id AS card_id, sum(t.amount) AS spend FROM transactions t JOIN user_cards u ON u.id = t.user_card_id GROUP BY 1, 2), n AS (SELECT DISTINCT user_id, benefit_id FROM confirmations)
SELECT o.user_id, o.card_id, f.benefit_id, coalesce(s.spend, 0) AS cycle_spend, n.user_id IS NOT NULL AS is_confirmed FROM o JOIN f USING (card_id) LEFT JOIN s ON s.user_id = o.user_id AND s.card_id = o.card_id LEFT JOIN n ON n.user_id = o.user_id AND n.benefit_id = f.benefit_id""")
def dom13_deal_snapshot(spark, sf_dir):
    """Every user's card and benefit with what the ranking needs."""
    cards = view(spark, sf_dir, "user_cards")
    spent = view(spark, sf_dir, "transactions").select("user_card_id", "amount").join(cards.select(F.col("id").alias("user_card_id"), "user_id", F.col("catalog_card_id").alias("card_id")), "user_card_id").select("user_id", "card_id", F.col("amount").alias("spend"))
    return P.deal_snapshot(view(spark, sf_dir, "card_benefit_mapping"), view(spark, sf_dir, "benefits").select(F.col("id").alias("benefit_id")), view(spark, sf_dir, "card_catalog").select(F.col("id").alias("card_id")),
        cards.where("is_active").select("user_id", F.col("catalog_card_id").alias("card_id")), spent, view(spark, sf_dir, "confirmations"))


@query("""SELECT c.id, count(*) AS uses FROM card_catalog c JOIN user_cards u ON u.catalog_card_id = c.id WHERE u.is_active AND EXISTS (SELECT 1 FROM deal_sources d WHERE d.catalog_card_id = c.id) AND u.user_id IN (SELECT user_id FROM confirmations) GROUP BY c.id""")
def src9_semi_joined(spark, sf_dir):
    """Cards in use that have deals, of users with confirmations: semi joins where lists of ids were sent."""
    users = view(spark, sf_dir, "user_cards").where("is_active").join(view(spark, sf_dir, "confirmations").select("user_id"), "user_id", "left_semi")
    cards = view(spark, sf_dir, "card_catalog").select("id").join(view(spark, sf_dir, "deal_sources").select(F.col("catalog_card_id").alias("id")), "id", "left_semi")
    return users.select(F.col("catalog_card_id").alias("id")).join(cards, "id").groupBy("id").agg(F.count("*").alias("uses"))


_HASHES = "CASE p_partkey % 3 WHEN 0 THEN 'a' ELSE 'B' END || CAST(p_partkey % 200 AS STRING)"


@query(f"""WITH k AS (SELECT lower({_HASHES}) AS h, p_partkey % 97 AS c FROM part WHERE p_partkey % 2 = 0), v AS (SELECT lower({_HASHES}) AS h1, 'z' || CAST(p_partkey % 50 AS VARCHAR) AS h2, p_partkey % 89 AS c FROM part WHERE p_partkey % 5 = 0),
b AS (SELECT h, c FROM k UNION SELECT h1, c FROM v UNION SELECT h2, c FROM v), q AS (SELECT DISTINCT lower({_HASHES}) AS h FROM part UNION SELECT 'z7')
SELECT q.h AS url_hash, coalesce(string_agg(DISTINCT CAST(b.c AS VARCHAR), ',' ORDER BY CAST(b.c AS VARCHAR)), '') AS cards FROM q LEFT JOIN b ON b.h = q.h GROUP BY q.h""")
def set3_bindings(spark, sf_dir):
    """The cards bound to each url."""
    part = view(spark, sf_dir, "part")
    keys = part.where("p_partkey % 2 = 0").selectExpr(f"lower({_HASHES}) AS url_hash", "CAST(p_partkey % 97 AS STRING) AS card_id")
    seen = part.where("p_partkey % 5 = 0").selectExpr(f"lower({_HASHES}) AS submitted_hash", "'z' || CAST(p_partkey % 50 AS STRING) AS final_hash", "CAST(p_partkey % 89 AS STRING) AS card_id")
    return P.bindings(keys, seen, part.selectExpr(f"{_HASHES} AS url_hash").union(spark.sql("SELECT 'Z7'")))


@query("SELECT k, min(pos) AS pos FROM transactions WHERE lower(category) = 'groceries' OR lower(category) = 'food' GROUP BY k, lower(category)")
def flt6_category_after_dedup(spark, sf_dir):
    """Purchases of categories, in any case, of the rows that stay when repeated ones have gone."""
    once = view(spark, sf_dir, "transactions").groupBy("k").agg(F.min_by("category", "pos").alias("category"), F.min("pos").alias("pos"))
    return once.where(F.lower("category").isin("groceries", "food")).select("k", "pos")


@query("SELECT t.pos, t.amount FROM transactions t WHERE t.user_id = 7 AND EXISTS (SELECT 1 FROM user_cards u WHERE u.user_id = t.user_id AND u.is_active)")
def flt16_owner_rows(spark, sf_dir):
    """One owner's rows, if the owner has an active profile."""
    active = view(spark, sf_dir, "user_cards").where("is_active AND user_id = 7").select("user_id")
    return view(spark, sf_dir, "transactions").where("user_id = 7").join(active, "user_id", "left_semi").select("pos", "amount")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) > 40 ORDER BY conv_id DESC, turn")
def src11_unprocessed(spark, sf_dir):
    """What still waits, newest first."""
    return view(spark, sf_dir, "conversations").where("role = 'user' AND length(text) > 40").orderBy(F.desc("conv_id"), "turn").select("conv_id", "turn")


@query("SELECT id, card_name, created_at FROM jobs WHERE status = 'queued' AND staging_id IS NULL ORDER BY created_at, id")
def srt9_pending_requests(spark, sf_dir):
    return view(spark, sf_dir, "jobs").where("status = 'queued' AND staging_id IS NULL").orderBy("created_at", "id").select("id", "card_name", "created_at")


@query("SELECT id, bank, card_name FROM card_catalog WHERE NOT is_discontinued ORDER BY bank, card_name, id")
def srt10_catalog_list(spark, sf_dir):
    return view(spark, sf_dir, "card_catalog").where("NOT is_discontinued").orderBy("bank", "card_name", "id").select("id", "bank", "card_name")


@query("""SELECT id, status, updated_at, CASE WHEN status = 'failed' AND attempt_count < 3 THEN 'retry' WHEN status = 'failed' THEN 'review' ELSE 'none' END AS action FROM (SELECT id, status, attempt_count, coalesce(lease_expires_at, created_at) AS updated_at FROM jobs) ORDER BY updated_at DESC, id DESC LIMIT 100""")
def dom45_jobs_list(spark, sf_dir):
    """The first page of jobs, those changed last first, with what may be done about them."""
    rows = view(spark, sf_dir, "jobs").select("id", "status", "attempt_count", F.coalesce("lease_expires_at", "created_at").alias("updated_at"))
    action = F.when((F.col("status") == "failed") & (F.col("attempt_count") < 3), F.lit("retry")).when(F.col("status") == "failed", F.lit("review")).otherwise(F.lit("none"))
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(100).select("id", "status", "updated_at", action.alias("action"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 3800 WHEN 1 THEN 3800 + length(' MITC here 11-08-2001 SWIGGY order Rs. 120.50 paid x') + 1 WHEN 2 THEN 50 + length(' mitc ' || p_name) ELSE 3800 + length(' ' || p_name) END AS kept FROM part""")
def str25_pruned(spark, sf_dir):
    """How much of statements is left without their small print."""
    body = F.repeat(F.lit("ab cd "), 633)  # 3,798 characters
    body = F.concat(body, F.lit("zz"))
    line = F.lit("11-08-2001 SWIGGY order Rs. 120.50 paid x")
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    text = (
        F.when(k == 0, F.concat(body, F.lit("MITC and  more of it"))).when(k == 1, F.concat(body, F.lit("\n\nMITC here\n"), line, F.lit("\nList of branches: "), name))
        .when(k == 2, F.concat(F.substring(body, 1, 48), F.lit("zz mitc "), name)).otherwise(F.concat(body, F.lit(" "), name))
    )
    return spread(view(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.length(R.pruned(text)).alias("kept"))


@query("""SELECT p_partkey, '{' || CASE WHEN p_size < 48 THEN '"additions":' || p_size || ',' ELSE '' END || '"crawl_complete":true' || CASE WHEN p_partkey % 2 = 0 THEN ',"quarantine_reason":"why_' || p_partkey || '"' ELSE '' END || ',"source_manifest_hash":"' || sha256(p_name) || '"}' AS summary FROM part""")
def jsn9_sanitised_summary(spark, sf_dir):
    """Summaries with what they may keep."""
    k = F.col("p_partkey")
    made = F.concat(
        F.lit('{"token":"x","crawl_complete":true,"raw_body_stored":"true","proposals":"7","review_status":"odd","additions":'), F.when(F.col("p_size") < 48, F.col("p_size").cast("string")).otherwise(F.lit("1.5")),
        F.lit(',"source_manifest_hash":"'), F.sha2("p_name", 256), F.lit('","canonical_benefit_hash":"AB","quarantine_reason":"'), F.when(k % 2 == 0, F.concat(F.lit("why_"), k.cast("string"))).otherwise(F.lit("Not so")), F.lit('"}'))
    return spread(view(spark, sf_dir, "part"), "p_partkey").select("p_partkey", R.sanitised(made, R.SUMMARY).alias("summary"))


@query("""SELECT page_id, '{' || CASE WHEN error_code IS NOT NULL THEN '"error_code":"' || error_code || '",' ELSE '' END || '"http_status":' || http_status || ',"required":' || CASE WHEN required THEN 'true' ELSE 'false' END || ',"status":"' || status || '"}' AS attempt FROM attempts""")
def jsn10_sanitised_attempt(spark, sf_dir):
    """Attempts at sources with what they may keep."""
    rows = spread(view(spark, sf_dir, "attempts"), "page_id")
    made = F.to_json(F.struct("status", "http_status", "required", "error_code", "url", F.lit("secret").alias("headers"), F.lit(-1).alias("redirect_count")))
    return rows.select("page_id", R.sanitised(made, R.ATTEMPT).alias("attempt"))


@query("""SELECT p_partkey, l.no AS line_no, CASE l.no WHEN 1 THEN 'percent_discount' WHEN 3 THEN 'bogo' ELSE 'lounge_access' END AS value_type, CASE l.no WHEN 3 THEN 100.0 * (p_size + 1) WHEN 6 THEN CAST(p_size AS DOUBLE) END AS value, CASE l.no WHEN 1 THEN CAST(p_size AS DOUBLE) END AS rate, CASE WHEN l.no = 1 AND p_partkey % 2 = 0 THEN 300.0 END AS cap
FROM part, (VALUES (1), (3), (6)) AS l(no) WHERE l.no <> 3 OR p_partkey % 3 > 0""")
def dom19_document_benefits(spark, sf_dir):
    """Benefits whose terms stand on several lines."""
    from cardloom.operators.extraction import document_benefits

    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    text = F.concat(
        F.lit("About the card\n\n"), n, F.lit("% off at dining places\n"), F.when(k % 2 == 0, F.lit("maximum of Rs. 300\n")).otherwise(F.lit("on all days\n")), F.lit("Buy one cinema ticket and get one free\n"),
        F.when(k % 3 == 0, F.lit("Enjoy the show\ncapped at Rs. 5, twice\n")).otherwise(F.concat(F.lit("valid twice per month\ncapped at Rs. "), n, F.lit("00 and Rs. 1\n"))), F.lit("Complimentary lounge: "), n, F.lit(" visits\n"))
    text = F.regexp_replace(text, F.concat(F.lit("capped at Rs. "), n, F.lit("00")), F.concat(F.lit("capped at Rs. "), ((F.col("p_size") + 1) * 100).cast("string")))
    return document_benefits(view(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "p_partkey", "t").select("p_partkey", "line_no", "value_type", "value", "rate", "cap")


@query("""WITH x AS (SELECT p_partkey % 50 AS card_id, p_partkey, p_size % 3 AS c FROM part WHERE p_partkey % 7 > 1) SELECT card_id, 'cashback' AS value_type, 'cashback:cashback:' || CASE WHEN card_id % 2 = 0 THEN 'fuel' ELSE 'dining' END AS subject, CAST(5 + c AS DOUBLE) AS rate, CAST(100 AS DOUBLE) AS cap, count(*) AS pages FROM x GROUP BY card_id, c""")
def dom20_projected_offers(spark, sf_dir):
    """What the lines of many pages come to, card by card."""
    from cardloom.operators.extraction import benefits, projected

    k = F.col("p_partkey")
    line = F.concat((F.col("p_size") % 3 + 5).cast("string"), F.lit("% cashback on "), F.when(k % 50 % 2 == 0, F.lit("fuel")).otherwise(F.lit("dining")), F.lit(" spends, capped at Rs. 100"))
    line = F.when(k % 7 == 0, F.concat(F.lit("Earlier, "), line)).when(k % 7 == 1, F.concat(line, F.lit(" is not eligible"))).otherwise(line)
    part = view(spark, sf_dir, "part").select((k % 50).alias("card_id"), F.concat(F.lit("https://h/"), k.cast("string")).alias("url"), line.alias("line"))
    found = benefits(part, "url", "line").join(part, "url")
    return projected(found, "card_id", "url", "line").select("card_id", "value_type", "subject", "rate", "cap", "pages")


@query("""SELECT g, CASE WHEN n < 5 THEN 'running' WHEN g % 4 = 1 THEN 'blocked' WHEN g % 5 = 0 OR g % 7 = 0 THEN 'blocked' ELSE 'passed' END AS status,
CASE WHEN n < 5 THEN 'pilot_incomplete' WHEN g % 4 = 1 THEN 'pilot_job_count' ELSE concat_ws(',', CASE WHEN g % 5 = 0 THEN 'pilot_issuer_diversity' END, CASE WHEN g % 7 = 0 THEN 'pilot_crawl_incomplete' END, CASE WHEN g % 7 = 0 THEN 'unsafe_mutation' END) END AS blockers
FROM (SELECT g, count(*) AS n FROM (SELECT p_partkey - p_partkey % 5 AS k, (p_partkey - p_partkey % 5) / 5 AS g FROM part) GROUP BY g)""")
def dom33_pilot_gate(spark, sf_dir):
    """Pilots that may be promoted, and what holds others back."""
    from cardloom.operators import crawl as W

    k = F.col("p_partkey")
    g = ((k - k % 5) / 5)
    rows = view(spark, sf_dir, "part").select(
        g.alias("g"), ((g % 4 == 0) | (g % 4 == 1) & (k % 5 < 2)).alias("promoted"), F.get(F.array(*[F.lit(p) for p in W.PROFILES]), (k % 5).cast("int")).alias("profile"), F.concat(F.lit("i"), F.when(g % 5 == 0, k % 2).otherwise(k % 4).cast("string")).alias("issuer"),
        *[F.lit(True).alias(c) for c in ("safety_valid", "evidence_valid", "replay_passed", "side_effects_passed", "source_valid")], (g % 7 != 0).alias("crawl_complete"), F.lit(0).alias("suppressed"), F.lit(0).alias("conflicts"), F.when(g % 7 == 0, 1).otherwise(0).alias("unsafe"))
    return W.pilot_gate(rows, "g")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'size ' || p_size || chr(10) || p_name WHEN 1 THEN p_name || chr(10) || 'size ' || p_size WHEN 2 THEN p_name || chr(10) || 'two' END AS text, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS pages,
  CASE p_partkey % 6 WHEN 3 THEN 'oversized' WHEN 4 THEN 'not_pdf' WHEN 5 THEN 'encrypted' END AS reason FROM part""")
def src15_pdf_text(spark, sf_dir):
    """Text and pages of PDF files, or why there are none: lines out of order, two pages, 65 pages, another format, an encrypted file."""
    from cardloom.functions.recover import read_pdfs

    page, end = "1 0 obj <</Type /Page>> endobj\n", "\nendstream endobj\n"
    stream = lambda *shown: F.concat(F.lit("2 0 obj <</Length 9>> stream\nBT /F1 12 Tf "), *[F.lit(x) if isinstance(x, str) else x for x in shown], F.lit(" ET" + end))
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    made = F.get(F.array(
        F.concat(F.lit("%PDF-1.4\n" + page), stream("1 0 0 1 50 100 Tm (", name, ") Tj 1 0 0 1 50 700 Tm [(si) -20 (ze\\040)] TJ (", size, ") Tj")), F.concat(F.lit("%PDF-1.7\n" + page), stream("14 TL 0 700 Td (", name, ") Tj T* (size ", size, ") Tj")),
        F.concat(F.lit("%PDF-1.4\n" + page * 2), stream("(", name, ") Tj"), stream("(two) Tj")), F.concat(F.lit("%PDF-1.4\n" + page * 65), stream("(", name, ") Tj")), F.concat(F.lit("PK"), name), F.concat(F.lit("%PDF-1.4\ntrailer <</Encrypt 3 0 R>>"), name)), (F.col("p_partkey") % 6).cast("int"))
    return view(spark, sf_dir, "part").select("p_partkey", read_pdfs(made.cast("binary")).alias("r")).select("p_partkey", "r.text", "r.pages", "r.reason")


_ENDS = """CASE p_partkey % 8 WHEN 0 THEN 'The Orbit ' || p_brand || ' card is discontinued since May' WHEN 1 THEN 'This card has been withdrawn' END"""


_ORBIT = "'Orbit ' || CASE page_id % 3 WHEN 0 THEN 'Nova' WHEN 1 THEN 'Lyra' ELSE 'Vega' END"


@query(f"""WITH p AS (SELECT page_id, {_ORBIT} AS name FROM pages WHERE html IS NOT NULL)
SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'Star ' || name || ' Credit Card This card has been discontinued.' WHEN 1 THEN 'Star ' || name || ' Credit Card Status Withdrawn' WHEN 2 THEN 'Star ' || name || ' Credit Card ' || name || ' is no longer issued.'
  WHEN 3 THEN 'Star ' || name || ' Credit Card Status: discontinued effective 31 August 2026.' WHEN 4 THEN 'Star ' || name || ' Credit Card No longer available' END AS evidence
FROM p""")
def str37_ended_product(spark, sf_dir):
    """Evidence that a page's product is no longer issued: whole pages, with what their issuer says of it at their end."""
    head, other = "'<h2>Star ' || name || ' Credit Card</h2>'", "'<h3>Star Comet Credit Card</h3>'"
    said = f"""CASE page_id % 12 WHEN 0 THEN {head} || '<h3>Important notice</h3><p>This card has been discontinued.</p>' WHEN 1 THEN '<table><tr><th>Star ' || name || ' Credit Card</th><td>Status</td><td>Withdrawn</td></tr></table>'
      WHEN 2 THEN {head} || '<p>' || name || ' is no longer issued.</p>' WHEN 3 THEN {head} || '<p>Status: discontinued effective 31 August 2026.</p>' WHEN 4 THEN {head} || '<div class="status">No longer available</div>'
      WHEN 5 THEN {head} || {other} || '<p>This card has been discontinued.</p>' WHEN 6 THEN {head} || '<p>Compare it with Comet. This card has been discontinued.</p>' WHEN 7 THEN {head} || '<p>This card has not been discontinued.</p>'
      WHEN 8 THEN '<table><tr><td>Star ' || name || ' Credit Card</td><td>Comet</td><td>Discontinued</td></tr></table>' WHEN 9 THEN {head} || '<p>Lounge access of the partner programme was discontinued.</p>' WHEN 10 THEN {other} || '<p>This card has been withdrawn.</p>' ELSE {head} END"""
    pages = _case(spark, sf_dir, "pages", "page_id", f"{_ORBIT} AS name", "html").where("html IS NOT NULL").selectExpr("page_id", "name", f"html || {said} AS html", "'Star Bank' AS issuer")
    return ended_products(pages, "html", "name", "issuer").select("page_id", "evidence")
