"""Fingerprints against a plain implementation; the match guarantee; successors by id."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from sparktext.llm import winnowing


def plain(text, hashes, k=3, w=4):
    units = re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text)
    if not units:
        return []
    n = max(len(units) - k + 1, 1)
    grams = [hashes(tuple(units[i : i + k])) for i in range(n)]
    out = []
    for i in range(max(n - w + 1, 1)):
        window = grams[i : i + w]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        if (at, grams[at]) not in out[-1:]:
            out.append((at, grams[at]))
    return out


def test_fingerprints_equal_a_plain_implementation(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("aa bb cc dddddddddd é".split()) for _ in range(n)) for n in (0, 1, 2, 3, 5, 6, 7, 30, 200)] + ["x" * 100, " \n ", "a\x85b \x1c c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    grams = {tuple(re.findall(r"[^ \t\n\x0b\f\r]{1,8}", t)[i : i + 3]) for t in texts for i in range(200)} - {()}
    grams |= {g[:n] for g in grams for n in (1, 2)}
    units = spark.createDataFrame([(list(g),) for g in grams], "g array<string>")
    # The hash of a gram is the library's; its choice and its place are not.
    own = units.select("g", F.shiftrightunsigned(F.xxhash64(*[F.xxhash64(F.get("g", i)) for i in range(3)]), 32).alias("full"),
                       F.shiftrightunsigned(F.xxhash64(*[F.xxhash64(F.get("g", i)) for i in range(2)]), 32).alias("two"),
                       F.shiftrightunsigned(F.xxhash64(F.xxhash64(F.get("g", 0))), 32).alias("one")).collect()
    table = {tuple(r.g): (r.one, r.two, r.full)[len(r.g) - 1] for r in own}
    got = {r.doc_id: [(p["place"], p["hash"]) for p in r.fingerprint] for r in winnowing.fingerprints(docs).collect()}
    assert got == {i: plain(t, table.get) for i, t in enumerate(texts)}


def test_shared_stretches_are_seen(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = " ".join(word() for _ in range(6))
    texts = [" ".join(word() for _ in range(rng.randint(0, 20))) + f" {shared} " + " ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{p["hash"] for p in r.fingerprint} for r in winnowing.fingerprints(docs).collect()]
    assert all(a & b for a in sets for b in sets)


def test_edits_and_successors(spark):
    rng = random.Random(3)
    rows = [(i * 3, "".join(rng.choice("abé \n") for _ in range(rng.choice([0, 1, 3, 4, 50, 200])))) for i in range(120)]
    rows += [(400, None), (401, "one"), (401, "two"), (401, "two")]
    docs = spark.createDataFrame([(*r, "r", 2) for r in rows], "doc_id bigint, text string, range string, key int")
    got = winnowing.compare_edited(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    first = [(i, t or "") for i, t in sorted(rows[:121], key=lambda r: r[0])]
    for (i, text), (_, after) in zip(first[:-1], first[1:], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert by_id[i].n_chars == len(text)
        assert by_id[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= by_id[i].near_edited <= 1
        assert edited != text or by_id[i].near_edited == 1
    assert by_id[400].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.n_chars for r in got if r.doc_id == 401) == [3, 3, 3]


def test_single_row_null_id_and_empty_table(spark):
    one = winnowing.compare_edited(spark.createDataFrame([(None, "abcdefgh")], "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(None, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    assert winnowing.compare_edited(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def everywhere(text, k=3):
    """Whole grams in order, as tuples of units."""
    units = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text):
        units += [(run, 1)] if len(run) <= 8 else [(run[i : i + 8], len(run[i : i + 8])) for i in range(len(run))]
    grams = []
    for i in range(len(units)):
        at, parts = i, []
        while at < len(units) and len(parts) < k:
            parts.append(units[at][0])
            at += units[at][1]
        if len(parts) == k:
            grams.append(tuple(parts))
    return grams


def test_places_and_windows_at_every_character(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abc文é𝄞") for _ in range(rng.choice([1, 3, 8, 9, 17, 60]))) for _ in range(n)) for n in (0, 1, 2, 3, 7, 20)] + ["x" * 24, "x" * 23, "abcdefghi j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    wide = {r.doc_id: r.fingerprint for r in winnowing.fingerprints(docs, window=1, select=winnowing.selected_everywhere).collect()}
    got = {r.doc_id: [(p["place"], p["hash"]) for p in r.fingerprint] for r in winnowing.fingerprints(docs, select=winnowing.selected_everywhere).collect()}
    by_gram = {}
    for i, text in enumerate(texts):
        grams = everywhere(text)
        hashes = [p["hash"] for p in wide[i]]
        assert [p["place"] for p in wide[i]] == list(range(max(len(grams), min(len(text), 1))))
        for g, h in zip(grams, hashes, strict=len(grams) > 0):
            assert by_gram.setdefault(g, h) == h
        out = []
        for at in range(max(len(hashes) - 3, min(len(hashes), 1))):
            part = hashes[at : at + 4]
            one = at + max(j for j, h in enumerate(part) if h == min(part))
            out += [(one, hashes[one])] if (one, hashes[one]) not in out else []
        assert got[i] == out
    assert len(set(by_gram.values())) == len(by_gram)


def test_unspaced_stretches_are_seen_at_any_offset(spark):
    rng = random.Random(5)
    run = lambda n: "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(n))
    shared = run(27)
    texts = [run(40 + i) + shared + run(rng.randint(0, 50)) for i in range(16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{p["hash"] for p in r.fingerprint} for r in winnowing.fingerprints(docs, select=winnowing.selected_everywhere).collect()]
    assert all(a & b for a in sets for b in sets)
    # The query's own table: a passage of 1,000 characters, shifted by 3.
    long = run(1000)
    pair = spark.createDataFrame([(1, long), (2, "abc" + long)], "doc_id bigint, text string")
    assert all(r.near_next > 0.9 for r in winnowing.compare_edited(pair).collect())
    # A text shorter than a gram is told from others by all its units.
    odd = winnowing.fingerprints(spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id bigint, text string"), select=winnowing.selected_everywhere).collect()
    assert odd[0].fingerprint != odd[1].fingerprint


def test_shared_words_are_seen_everywhere(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 5, 8, 11, 20])))
    shared = " ".join(word() for _ in range(6))
    texts = [" ".join(word() for _ in range(rng.randint(0, 20))) + f" {shared} " + " ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{p["hash"] for p in r.fingerprint} for r in winnowing.fingerprints(docs, select=winnowing.selected_everywhere).collect()]
    assert all(a & b for a in sets for b in sets)
