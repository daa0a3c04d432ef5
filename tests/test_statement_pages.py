"""Pages of planted reports, found as a reader would find them."""

from marlspan.operators import statement_pages as P

FIGURES = " ".join(f"{n:,}" for n in range(1000, 1015))


def test_pages_of_reports(spark):
    docs = {
        "plain": ["Table of contents\nbalance sheet\n" + FIGURES, "BALANCE  SHEET\nUSD in thousands\n" + FIGURES, FIGURES, FIGURES, "statement of cash flows " + FIGURES],
        "hebrew": ["דוחות כספיים", "דוח על המצב הכספי\nבאלפי ש״ח\n" + FIGURES, "םינמוזמ ימירזת תוחוד\n" + FIGURES],
        "letters": ["income statement without figures", FIGURES, None, ""],
        "late": ["income statement " + FIGURES, "in millions " + FIGURES, "nis in thousands " + FIGURES],
        "many": ["balance sheet " + FIGURES] * 20,
    }
    rows = [(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)]
    got = {}
    for r in P.statement_pages(spark.createDataFrame(rows, "doc_id string, page int, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["page"], list(r["kinds"]), r["unit_scale"], r["currency"]))
    got = {k: sorted(v) for k, v in got.items()}
    assert got["plain"] == [(1, ["BS"], 3, "USD"), (2, [], 3, "USD"), (4, ["CF"], 3, "USD")]
    assert got["hebrew"] == [(1, ["BS"], 3, "ILS"), (2, ["CF"], 3, "ILS")]
    assert "letters" not in got
    assert got["late"] == [(0, ["IS"], 6, None), (1, [], 6, None)]
    assert [p for p, *_ in got["many"]] == list(range(14))
