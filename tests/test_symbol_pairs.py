from lodestone.functions import phones
from lodestone.plans import catalog


def test_every_pair_of_symbols(spark):
    """Pairs that no name has are there too."""
    rows = catalog.queries()["symbol_pairs"](spark, "/root/testdata/sf0.001").collect()
    n = len(phones.SYMBOLS)
    assert {(r.a, r.b): r.cost for r in rows} == {(a, b): round(phones.symbol_cost(a, b), 9) for a in phones.SYMBOLS for b in phones.SYMBOLS if a < b}
    assert len(rows) == n * (n - 1) // 2 and {r.met for r in rows} == {True, False}
