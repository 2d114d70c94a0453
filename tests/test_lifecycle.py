"""What pages say of the end of products, for the card Orbit of Lumen Bank."""

import itertools

import pytest
from pyspark.sql import functions as F  # noqa: F401

from cardloom.functions import lifecycle as L
from cardloom.operators.lifecycle import ended_products

OWN, OTHER = "Lumen Orbit Credit Card", "Lumen Comet Credit Card"
VERBS = ("has been discontinued", "is withdrawn", "is no longer issued", "is no longer available")


def under(*blocks):
    return f"<h2>{OWN}</h2>" + "".join(b if b.startswith("<") else f"<p>{b}</p>" for b in blocks)


def row(*cells):
    return "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>"


#: What ends the product: its own name, "this card", bare status words; sections with plain words do not end its heading.
ENDS = [
    *[under(f"{who} {verb}.") for who, verb in itertools.product(("This card", "The credit card", "Orbit", "The Orbit card"), VERBS)],
    *[under(f"<h3>{section}</h3>", "This card is withdrawn.") for section in ("Key features", "Important information", "Lumen Bank charges", "Fees and charges")],
    f"<p>{OWN} has been discontinued from 1 May 2024.</p>", under("Effective 1 May 2024, this credit card is no longer issued."), under("Status: withdrawn from May 2024"),
    under('<span data-status="availability">Withdrawn</span>'), under('<p aria-label="card status">No longer issued</p>'), row(OWN, "Withdrawn"), row("Lumen Orbit", "Status", "no longer available from June 2024"),
    f"<h2>{OTHER}</h2><p>Apply today.</p>" + under("This card is withdrawn."), under("Apply for it.", "<h4>Notice</h4>", "This card is withdrawn."),
]
#: What speaks of something else, compares, denies, or says nothing.
GOES_ON = [
    *[f"<h2>{OTHER}</h2><p>This card {verb}.</p>" for verb in VERBS], *[under(f"<h3>{OTHER}</h3>", f"This card {verb}.") for verb in VERBS], under("<h3>Comet Prime</h3>", "This card is withdrawn."),
    under(f"{OTHER} has been discontinued."), under("Comet is withdrawn."), under("Selected partners have been discontinued."), under("The lounge programme of Skyways is withdrawn."), under("Orbit is withdrawn while Comet stays."),
    under("A successor to Comet. This card is withdrawn."), under("Compare it with others.", "Read on.", "This card is withdrawn."), under("Owing to Comet, this card is withdrawn."), under("Comet.", "This card is withdrawn."),
    under('<div class="availability">Comet withdrawn</div>'), under("Status: Comet withdrawn"), under("Status: “Lumen Lounge Credit Card” withdrawn"), under("Status - (Lumen Update Credit Card) is withdrawn"),
    row(OWN, "Comet Prime", "Withdrawn"), row(f"{OWN} or Comet withdrawn"), row(OWN, "not withdrawn"), row(OTHER, "Withdrawn"), row(f"{OWN}: Lumen March Credit Card withdrawn"), under("This card has not been discontinued."),
    under("Apply for it."), under(row("Comet", "x"), "This card is withdrawn."), under('<div class="product-tile"><p>This card is withdrawn.</p></div>'), under(f"<script>{OWN} has been discontinued.</script>"), "", OWN,
]


def of(spark, rows):
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, html string, card string, bank string")
    return [r["evidence"] for r in ended_products(pages, "html", "card", "bank").orderBy("id").collect()]


@pytest.mark.parametrize("name", ["Orbit", OWN])
def test_evidence_is_of_the_product(spark, name):
    got = of(spark, [(h, name, "Lumen Bank") for h in [*ENDS, *GOES_ON, None]])
    assert [p for p, e in zip(ENDS, got) if e is None] == [] and [p for p, e in zip([*GOES_ON, None], got[len(ENDS) :]) if e is not None] == []
    assert got[0] == f"{OWN} This card has been discontinued."


def test_evidence_of_odd_products(spark):
    page = under("This card is withdrawn.")
    named = "<p>Lumen Orbit card has been discontinued.</p>"
    rows = [(page, "Credit Card", "Lumen Bank"), (page, None, "Lumen Bank"), (page, "Orbit", None), (named, "Orbit (1.0+)", "Lumen"), (named + "x " * 200_000, "Orbit", "Lumen")]
    assert of(spark, rows) == [None, None, f"{OWN} This card is withdrawn.", *["Lumen Orbit card has been discontinued."] * 2]


def test_excerpts_hide_what_urls_carry_and_are_short(spark):
    page = under("This card is withdrawn, see https://lumen.example/notice?token=1 " + "status " * 200)
    [found] = of(spark, [(page, "Orbit", "Lumen Bank")])
    assert found is not None and "https://lumen.example/notice " in found and "token" not in found and len(found) <= L.EXCERPT


def test_the_first_heading_and_the_plainest_rule_give_the_excerpt(spark):
    page = under("Status: withdrawn.", f"{OWN} is discontinued.") + under("This card has been withdrawn.")
    assert of(spark, [(page, "Orbit", "Lumen Bank")]) == [f"{OWN} {OWN} is discontinued."]
    assert of(spark, [(page + row(OWN, "Withdrawn"), "Orbit", "Lumen Bank")]) == [f"{OWN} Withdrawn"]
