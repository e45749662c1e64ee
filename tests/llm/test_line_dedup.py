"""Line dedup against brute force, with hot lines, ties and odd input."""

import random
from collections import defaultdict

import pytest

from sparktext.llm import line_dedup


def brute(rows, min_docs, keep="none", min_chars=1):
    places = defaultdict(list)
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for d, row in enumerate(distinct):
        for i, line in enumerate((row[1] or "").encode().lower().split(b"\n")):
            key = line.strip(b" \t\n\v\f\r")
            if len(key.decode()) >= min_chars:
                places[key].append((d, i))
    gone = set()
    for at in places.values():
        if len({d for d, _ in at}) >= min_docs:
            gone |= set(at[1:] if keep == "first" else at)
    out = {}
    for d, row in enumerate(distinct):
        lines = (row[1] or "").split("\n")
        kept = [x for i, x in enumerate(lines) if (d, i) not in gone]
        out[row] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"line {i} É" for i in range(15)] + ["", "  ", "x", "\t"]
    rows = []
    for i in range(80):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(rng.choice([x, x.upper().replace("É", "É"), f" {x}\t"]) for x in lines)))
    rows += [(100 + i, "Everywhere \n" * rng.randint(1, 3) + f"q{i}") for i in range(60)]
    return [*rows, (200, None), (201, ""), (202, "\n\n"), (203, "x\x1cy"), (204, "a\r\nb")]


@pytest.mark.parametrize(("seed", "min_docs", "min_chars"), [(1, 10, 1), (2, 2, 3), (3, 1, 1)])
def test_lines_equal_brute_force(spark, seed, min_docs, min_chars):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id bigint, text string, pos int, part string")
    got = line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs, min_docs=min_docs, min_chars=min_chars)).collect()
    want = brute(rows, min_docs, min_chars=min_chars)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == {r[0]: v for r, v in want.items()}


def test_first_occurrence_stays(spark):
    # One document order for both sides: ids ascend, texts differ.
    rows = [(i, f"own {i}\nshared\nmore {i % 3}\nshared") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs, min_docs=2, keep="first")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == {r[0]: v for r, v in brute(rows, 2, "first").items()}
    with pytest.raises(ValueError, match="keep"):
        line_dedup.line_bitmaps(docs, keep="last")


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a\nb"), (None, "a\nc"), (5, "a\nd"), (5, "a\nd"), (6, None)], "doc_id bigint, text string")
    got = line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs, min_docs=3)).collect()
    assert sorted((r.doc_id or -1, r.n_dropped, r.kept_text) for r in got) == [(-1, 1, "b"), (-1, 1, "c"), (5, 1, "d"), (5, 1, "d"), (6, 0, "")]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.keep_lines(empty, line_dedup.line_bitmaps(empty)).collect() == []
