"""Line dedup against a brute-force version, on awkward rows and with many batches."""

import pytest

pytest.importorskip("wardline.llm")
from tests.compare import connect, differences  # noqa: E402
from wardline.llm import linededup  # noqa: E402
from wardline.llm.oracles import ORACLES  # noqa: E402
from wardline.llm.queries import QUERIES  # noqa: E402

LONG = "a line that is long enough"
ROWS = [
    (3, f"{LONG}\nthird only text\n{LONG}", "a"),
    (1, f"\t{LONG.upper()} \nshort\nshort", "b"),
    (2, "short\nÉÉÉÉÉÉÉÉÉÉ\n", "c"),
    (4, "éÉÉÉÉÉÉÉÉÉ\nÉÉÉÉÉÉÉÉÉÉ", "d"),
    (5, None, "e"),
    (6, "", None),
    (7, "one row of seven\nthe repeated row", "f"),
    (7, "the repeated row\none row of seven", "g"),
    (8, "the repeated row", "h"),
    (None, f"{LONG}\nonly without an id", "i"),
    (None, "only without an id", "j"),
    (None, "only without an id", "j"),
    (9, "x" * 200_000 + "\n" + LONG, "k"),
    (10, "x" * 200_000, "l"),
]
SCHEMA = "doc_id long, text string, drop string"


def brute(rows, min_chars=10):
    def key(line):
        line = line.strip(linededup.BLANK)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
        return low if len(low) >= min_chars else None

    # rows without an id are documents of their own, after all others
    names = [(i is None, n if i is None else i) for n, (i, *_) in enumerate(rows)]
    owner = {}
    for own, (_, text, _) in zip(names, rows):
        for line in (text or "").split("\n"):
            k = key(line)
            if k is not None:
                owner[k] = min(owner.get(k, own), own)
    out = []
    for own, (i, text, more) in zip(names, rows):
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) is None or owner[key(x)] == own]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay), more))
    return sorted(map(repr, out))


@pytest.mark.parametrize("batches,fan_in", [(1, 2), (4, 2), (7, 3)])
def test_brute_force(spark, batches, fan_in):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("drop", "key")
    got = linededup.dedup_lines(docs, batches=batches, fan_in=fan_in, carry=("key",))
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(ROWS)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_many_rows_without_id(spark):
    """A key of every row without id: one keeps it, and no group gathers what all rows drop."""
    rows = [(None, "\n".join(f"line {i % 2} {j} of many" for j in range(30)), "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = linededup.dedup_lines(docs)
    assert got.where("n_dropped = 0").count() == 2
    assert got.where("n_dropped = 30 and text = ''").count() == 2998


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert linededup.dedup_lines(docs).count() == 0


def test_matches_sql(spark, sf_dir):
    name = "op7_line_dedup"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []
