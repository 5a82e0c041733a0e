"""The ten operators against plain versions, and their cases at the edges."""

import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lockstep.llm import factors, op5_toxicity, op6_language, op8_decontamination, radix
from lockstep.llm.components import components
from lockstep.llm.op1_quotes import conversations
from lockstep.llm.op2_suffix_dedup import op2_suffix_dedup, suffix_dedup
from lockstep.llm.op3_packing import op3_packing, packed, token_ids, vocabulary
from lockstep.llm.op4_quality import POLICIES, ablations, judged, ledger, op4_quality
from lockstep.llm.op7_licenses import scan_licenses
from lockstep.llm.op8_decontamination import align, contaminated, decontaminate
from lockstep.llm.op9_lz_dedup import lz_dedup, op9_lz_dedup
from lockstep.llm.op10_simhash import links, op10_simhash, simhash_dedup, simhash_groups
from lockstep.llm.packing import pack, reduce_dominated
from lockstep.llm.registry import ORACLES, QUERIES
from lockstep.llm.windows import Passages

from . import brute

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id bigint, text string"


def by_id(rows, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows}


@pytest.fixture(scope="module")
def texts(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeats within and across documents, many bytes to a character, one long text, clashing columns."""
    random.seed(3)
    words = [f"w{random.randrange(400)}" for _ in range(6000)]
    long, passage = " ".join(words), "Ünïcode " * 3 + "the quick brown fox jumps over the lazy dog and then some more words follow here"
    rows = [(5, passage), (1, None), (2, ""), (3, "a " * 80), (4, passage + " tail"), (9, "x" * 120), (7, "x" * 49), (8, long), (10, long[500:9000]), (11, " \t\n"), (12, "ab" * 60), (6, passage), (13, "éè" * 40), (14, "é" + "éè" * 40)]
    return [(i, t) for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "f") for i, t in rows], f"{DOCS}, N_Bytes string, __w_id int, fingerprint string").repartition(3)


# 2 and 9: repeated windows.


@tables
def test_op2_on_the_table(spark, texts):
    got = by_id(op2_suffix_dedup(spark, SF).collect(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.op2(texts)


@tables
def test_op9_on_the_table(spark, texts):
    got = by_id(op9_lz_dedup(spark, SF).collect(), "n_words", "n_removed", "kept_sha256")
    assert got == brute.op9(texts)


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 2000, "flush": 50}, {"bucket_bytes": 2000, "crowd": 1}, {"crowd": 0}, {"bucket_bytes": 700, "fan": 7, "crowd": 1}])
def test_windows_at_the_edges(spark, odd, sizes):
    got = by_id(suffix_dedup(frame(spark, odd), emit="digest", keep=False, **sizes).collect(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.op2(odd)
    got = by_id(lz_dedup(frame(spark, odd), emit="digest", keep=False, **sizes).collect(), "n_words", "n_removed", "kept_sha256")
    assert got == brute.op9(odd)


def test_windows_keep_columns_and_texts(spark, odd):
    out = suffix_dedup(frame(spark, odd))
    assert out.columns == ["doc_id", "text", "fingerprint", "n_bytes", "n_removed", "n_spans", "kept_text", "removed_spans"]
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, t in odd:
        raw, r = (t or "").encode(), rows[i]
        cut = b"".join(raw[a:z] for a, z in zip([0, *(s["end"] for s in r["removed_spans"])], [*(s["start"] for s in r["removed_spans"]), len(raw)], strict=True))
        assert cut.decode("utf-8", "ignore") == r["kept_text"]
    assert rows[6]["kept_text"] == "Ü"[:0] + rows[6]["kept_text"]
    words = {r["doc_id"]: r["kept_text"] for r in lz_dedup(frame(spark, odd)).collect()}
    assert words[6] == ""
    assert words[7] == "x" * 49


def test_windows_of_repeated_rows_and_null_ids(spark):
    t = "some words that are long enough to fill the window of fifty bytes and more"
    x = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t + "!")], DOCS)
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix_dedup(x, emit="digest").collect())
    assert got == [(-1, 0), (1, len(t)), (1, len(t)), (2, len(t))]
    assert suffix_dedup(x.limit(0)).count() == 0
    assert lz_dedup(x.limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=8))
def test_windows_by_chance(spark, some):
    docs = list(enumerate(some))
    x = spark.createDataFrame(docs, DOCS)
    got = by_id(suffix_dedup(x, threshold=6, anchor=3, emit="digest", keep=False).collect(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.op2(docs, 6)


def test_windows_of_a_line_in_a_third_of_the_documents(spark):
    rng = random.Random(8)
    line = "this very common line stands in a third of all the documents that there are, in varied surroundings"
    some = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(30)) + (f" {line} " if i % 3 == 0 else "\n") + " ".join(f"v{rng.randrange(90)}" for _ in range(30))) for i in range(150)]
    for sizes in ({"crowd": 2}, {"crowd": 2, "bucket_bytes": 1500, "flush": 200}):
        got = by_id(suffix_dedup(frame(spark, some), emit="digest", keep=False, **sizes).collect(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.op2(some)
        got = by_id(lz_dedup(frame(spark, some), emit="digest", keep=False, **sizes).collect(), "n_words", "n_removed", "kept_sha256")
        assert got == brute.op9(some)


def passages(units):
    """Whole texts as passages: of the words or bytes in each."""
    texts = [u if isinstance(u, bytes) else " ".join(u).encode() for u in units]
    n = len(texts)
    return lambda width: Passages(np.arange(n), np.zeros(n, np.int64), np.array([len(u) - width + 1 for u in units]), np.arange(n), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab", min_size=11, max_size=40)), min_size=1, max_size=7), st.integers(1, 11))
def test_radix_order_finds_the_repeated_strings(some, depth):
    units = [t.encode() for _, t in some]
    got = set(zip(*(x.tolist() for x in radix.repeats(np.array([i for i, _ in some]), passages(units)(depth), depth)), strict=True))
    starts = [(i, k, p, u[p : p + depth]) for k, (u, (i, _)) in enumerate(zip(units, some, strict=True)) for p in range(len(u) - depth + 1)]
    assert got == {(k, p, p + depth) for i, k, p, u in starts if any(v == u and j < i for j, _, _, v in starts)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.sampled_from(["x", "yy", "é"]), min_size=5, max_size=25)), min_size=1, max_size=7), st.integers(1, 5))
def test_parse_takes_the_longest_factors(some, least):
    """Greedy, place by place, against every passage of a smaller document."""
    units = [u for _, u in some]
    got = sorted(zip(*(x.tolist() for x in factors.repeats(np.array([i for i, _ in some]), passages(units)(least), least)), strict=True))
    want = []
    for k, (i, u) in enumerate(some):
        p = 0
        while p + least <= len(u):
            n = max((n for j, v in some if j < i for q in range(len(v)) for n in range(least, min(len(u) - p, len(v) - q) + 1) if v[q : q + n] == u[p : p + n]), default=0)
            if n:
                want.append((k, p, p + n))
            p += max(n - least + 1, 1) if n else 1
    assert got == sorted(want)


# 10: SimHash.


@tables
def test_op10_on_the_table(spark, texts):
    assert by_id(op10_simhash(spark, SF).collect(), "fingerprint", "component_id") == brute.op10(texts)


@pytest.mark.parametrize("pairwise", [256, 2])
def test_op10_links_everything_near(spark, pairwise):
    rng = random.Random(4)
    prints = {0}
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            prints.add(f)
            for _ in range(rng.randrange(4)):
                f ^= 1 << rng.randrange(64)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in prints}
    got = links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), pairwise).collect()
    assert all((signed[r["u"]] ^ signed[r["v"]]).bit_count() <= 2 for r in got)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(got, "u bigint, v bigint")).collect()} if got else {}
    mine = brute.groups((roots.get(s, s), f) for s, f in signed.items())
    plain = brute.groups((r, f) for f, r in brute.components_of([(f, f) for f in prints]).items())
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


def test_op10_at_the_edges(spark, odd):
    assert by_id(simhash_groups(frame(spark, odd)).collect(), "fingerprint", "component_id") == brute.op10(odd)
    x = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (7, None), (9, "")], DOCS)
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash_groups(x).collect())
    assert got == [(0, 3), (3, 3), (3, 3), (7, 7), (9, 7)]
    assert simhash_groups(x.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in simhash_dedup(x).collect()) == [0, 3, 3, 7]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(5, 5), (None, 3)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert {roots[i] for i in range(100, 161)} == {100}
    assert {roots[i] for i in range(1, 60)} == {1}


# 3: packing.


def whole(rows):
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(n for _, n in spans) <= 2048
    return at


@tables
def test_op3_on_the_table(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    rows = op3_packing(spark, SF).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces.pop(i)
        assert len(own) == -(-len(ids) // 2048)
        for p, r in own.items():
            part = ids[p * 2048 : (p + 1) * 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (p * 2048, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    lengths = [r["length"] for r in rows]
    assert len(whole(rows)) <= max(-(-sum(lengths) // 2048), brute.fewest(lengths, 2048)) + 1


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    odd = ["", " ", "A.B, c!d", "I İstanbul ŁÓDŹ.", "don't stop,", "x\x01y \x01 z", "10,000.50 $%&", " nbsp em\x0bvt\x0cff\x85nel", "ﬁne Ⅳ ½", "日本語 テスト。", "été.", "ab...", ".,", "<|endoftext|> a</w>", "🙂🙂 ok", "ß ẞ Σας ΣΑΣ.", "naïve NAÏVE Größe ŝercó ĳsje ŉ ªº µm ſtraße", "ALLCAPS MiXeD. WORDy, ÀÉ", "e\u0301te\u0301", "\ufeffbom", "straße\u00ad", "word's 'tis we'll", "ĿL ǆ ƀ"]
    ids, bounds = token_ids(pa.array([None, *odd]).slice(1), vocabulary())
    for t, a, z in zip(odd, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:z].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_op3_at_the_edges(spark, odd):
    rows = packed(frame(spark, [*odd, (8, odd[7][1]), (None, "a")]), with_ids=True).collect()
    assert len(whole(rows)) == -(-sum(r["length"] for r in rows) // 2048)
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2, 11)} == {1}
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packed(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 2), max_size=6))
def test_reduction_loses_no_bin(counts):
    while sum(counts.values()) > 9:
        counts.popitem()
    plan = pack(counts, 20)
    used = {}
    for pattern, times in plan:
        assert sum(n * c for n, c in pattern) <= 20
        for n, c in pattern:
            used[n] = used.get(n, 0) + c * times
    assert used == counts
    fixed, left = reduce_dominated(counts, 20)
    assert sum(t for _, t in fixed) + brute.best_sum(left, 20) == brute.best_sum(counts, 20)


# 4: quality.


@tables
def test_op4_on_the_table(spark, texts):
    got = by_id(op4_quality(spark, SF).collect(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {i: brute.op4(t) for i, t in texts}


def test_op4_at_the_edges(spark, odd):
    rows = judged(ledger(frame(spark, [*odd, (20, "l\nl\n\n \nl\r\n#<|>"), (21, "aé😀 b\x0bc d")]))).collect()
    got = by_id(rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {i: brute.op4(t) for i, t in [*odd, (20, "l\nl\n\n \nl\r\n#<|>"), (21, "aé😀 b\x0bc d")]}
    assert all(not (r["kept"] and r["base_failed"]) for r in rows)
    assert ledger(frame(spark, odd).limit(0)).count() == 0


def test_ablations(spark, odd):
    rows = ledger(frame(spark, odd))
    bits = [r["fail_bits"] for r in rows.collect()]
    for r in ablations(rows).collect():
        names = [*{k: 0 for k in __import__("lockstep.llm.op4_quality", fromlist=["RULES"]).RULES}]
        mask = sum(1 << names.index(x) for x in POLICIES[r["policy"]])
        bit = 1 << names.index(r["rule"])
        assert r["failed"] == sum(bool(b & bit) for b in bits)
        assert r["kept"] == sum(b & mask == 0 for b in bits)
        assert r["kept_without"] == sum(b & mask & ~bit == 0 for b in bits)


def test_quotes_that_were_wrapped_anew(spark):
    said = "I would rather keep the old index until the new one has been measured on the whole table and nobody complains"
    w = said.split()
    again = "\n".join("> " + " ".join(w[i : i + 7]) for i in range(0, len(w), 7))
    rows = [(1, 0, "a", "Hello there\n" + said), (1, 1, "b", "Something else was said here by me today"), (1, 2, "c", f"On Monday a wrote:\n{again}\nAgreed."), (1, 3, "d", "> keep the old index until the new\nWhy?"), (1, 4, "e", "> Agreed.\nOK")]
    out = {r["turn"]: r for r in conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [out[t]["parent_turn"] for t in range(5)] == [None, None, 0, 0, 2]
    assert out[2]["body"] == "Agreed."
    assert [out[t]["position"] for t in range(5)] == [0, 4, 1, 2, 3]


def test_turns_that_many_rows_share(spark):
    rows = [(1, 0, "a", "first words of it")] * 50 + [(1, 1, "b", "x"), (None, 0, "a", "y"), (1, None, "a", "> first words of it"), (None, None, "a", None)] + [(2, 7, "a", "long " * 50000 + "\n> quoted")]
    out = conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(out) == len(rows)
    assert sorted((r["conv_id"] or -1, r["turn"] if r["turn"] is not None else -1, r["position"] if r["position"] is not None else -1) for r in out) == sorted([(1, 0, 0)] * 50 + [(1, 1, 50), (-1, 0, -1), (1, -1, -1), (-1, -1, -1), (2, 7, 0)])


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for p in os.listdir(SF):
        con.execute(f"CREATE VIEW {p[:-8]} AS SELECT * FROM read_parquet('{SF}/{p}')")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == sorted(str([v for _, v in sorted(zip(names, r, strict=True))]) for r in want.fetchall())


# 5 and 6: classifiers.


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = op5_toxicity.op5_toxicity(spark, sf)
    x = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    score, y, p = (np.array([r[c] for r in x]) for c in ("score", "toxic", "predicted"))
    auc = (score[y == 1][:, None] > score[y == 0]).mean()
    assert auc > 0.95
    assert p[y == 1].mean() > 0.8
    assert p[y == 0].mean() < 0.1


def test_toxicity_at_the_edges(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in odd] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    x = frame(spark, [*odd, (None, "x"), (3, "a")])
    rows = op5_toxicity.scored(x, op5_toxicity.train(x, labels)).collect()
    assert len(rows) == len(odd) + 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    none = op5_toxicity.train(x, labels.limit(0))
    assert op5_toxicity.scored(x, none).agg(F.max("predicted")).first()[0] == 0
    assert op5_toxicity.drop_toxic(x.limit(0), labels).count() == 0


def test_toxicity_of_long_texts_and_clashing_columns(spark):
    rows = [(i, ("you idiot and moron " if i % 3 == 0 else "a quiet day in the garden ") * (20000 if i == 3 else 3)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] * 2, "doc_id bigint, toxic int")
    x = spark.createDataFrame([(i, t, i, -1.0, True) for i, t in rows], "doc_id bigint, text string, toxic bigint, score double, held_out boolean")
    kept = op5_toxicity.drop_toxic(x, labels)
    assert kept.columns == x.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(60) if i % 3]


def votes_by_chance():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    vote = lambda hit, miss: (rng.random(2000) < np.where(y, hit, miss)).astype(int)
    good = vote(0.9, 0.02)
    return y, np.column_stack([good, good, vote(0.8, 0.03), vote(0.3, 0.3)])


def test_label_model_counts_voters_that_agree_once():
    y, votes = votes_by_chance()
    start = np.array([0.02, 0.5, 0.98])[np.minimum(votes[:, :3].sum(axis=1), 2)]
    model, q = op5_toxicity.fit_label_model(votes, np.ones(2000), start, 0.3)
    assert ((q > 0.5) == y).mean() > 0.93
    assert model.parent[1] == 0 or model.parent[0] == 1
    one = model.log_odds(np.array([[1, 1, 0, 0], [0, 0, 0, 0]]))
    alone = np.log(model.speaks[1, 0, 0] / model.speaks[0, 0, 0])
    assert abs(one[0] - one[1] - alone) < 0.3 * alone  # the second of the twins adds little


def test_label_model_against_a_plain_version():
    """The same rounds, one row and voter after the other, with the tree that was found."""
    y, votes = votes_by_chance()
    votes = votes[:60]
    start = [[0.02, 0.5, 0.98][min(sum(v[:3]), 2)] for v in votes.tolist()]
    model, q = op5_toxicity.fit_label_model(votes, np.ones(60), np.array(start), 0.3)
    rows, plain = votes.tolist(), list(start)
    mean = [sum(r[j] for r in rows) / 60 for j in range(4)]
    for tree, rounds in (([-1] * 4, 20), (model.parent.tolist(), 1)):
        for _ in range(rounds):
            chance = {}
            for c in (0, 1):
                share = [p if c else 1 - p for p in plain]
                for j in range(4):
                    for z in (0, 1):
                        here = [s for s, r in zip(share, rows, strict=True) if (r[tree[j]] if tree[j] >= 0 else 0) == z]
                        spoke = [s for s, r in zip(share, rows, strict=True) if r[j] and (r[tree[j]] if tree[j] >= 0 else 0) == z]
                        chance[c, z, j] = min(max((sum(spoke) + 0.5 * mean[j]) / (sum(here) + 0.5), 1e-4), 1 - 1e-4)
            new = []
            for r in rows:
                z = np.log(0.3 / 0.7) + sum(np.log(chance[1, r[tree[j]] if tree[j] >= 0 else 0, j] / chance[0, r[tree[j]] if tree[j] >= 0 else 0, j]) for j in range(4) if r[j])
                new.append(1 / (1 + np.exp(-z)))
            moved, plain = max(abs(a - b) for a, b in zip(new, plain, strict=True)), new
            if moved < 1e-4:
                break
    assert q == pytest.approx(plain, abs=1e-6)


def test_scores_against_a_plain_version():
    """Weights times log counts of whole words and word beginnings, summed text by text."""
    texts = ["you utter idiot", "Idiot, idiot! grand", "", "nothing here", "idiotic idea " * 5000]
    hashed = lambda u: int((op5_toxicity._hash([u])[0] + np.uint64(0)) >> np.uint64(64 - op5_toxicity.BITS))
    begin = lambda u, n: int((op5_toxicity._hash([u[:n]])[0] + np.uint64(n)) >> np.uint64(64 - op5_toxicity.BITS))
    rng = np.random.default_rng(1)
    weights = rng.normal(size=1 << op5_toxicity.BITS).astype(np.float32)
    model = op5_toxicity.Toxicity(np.ones(1 << op5_toxicity.BITS, bool), weights, -0.5, op5_toxicity.LabelModel())
    want = []
    for t in texts:
        found = [hashed(w) for w in re.findall("[a-z]+", t.lower())] + [begin(w, n) for w in re.findall("[a-z]+", t.lower()) for n in op5_toxicity.PREFIXES if len(w) > n]
        want.append(1 / (1 + np.exp(-(sum(weights[f] * np.log1p(found.count(f)) for f in set(found)) - 0.5))))
    assert model.score([t.encode() for t in texts]) == pytest.approx(want, abs=1e-5)


@tables
def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    x = op6_language.op6_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in x]) > 0.95


def test_language_at_the_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("the house", "en"), ("das Haus", "de"), (None, "en"), ("", "de"), ("123 !?", "en"), ("été", None)] * 4)]
    x = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = op6_language.identified(x, op6_language.train(x)).collect()
    for r in out:
        text = rows[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (text in (None, "", "123 !?"))
        assert 0 <= r["score"] <= 1
    none = op6_language.train(x.limit(0))
    assert {r["lang_pred"] for r in op6_language.identified(x, none).collect()} == {"und"}


def test_language_against_a_plain_version(spark):
    """Centroids and document frequencies as fitted; n-grams, weights and cosines one by one."""
    rng = random.Random(2)
    words = {"en": "the cat and dog house with that this there what".split(), "de": "der Hund und die Katze mit das Häuschen ist schön".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 30))) + rng.choice(["", "!", " 42", " — ñ"]), lang) for i in range(120) for lang in [rng.choice(["en", "de"])]]
    x = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = op6_language.train(x, sample=60)
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]

    def grams(text):
        padded = "".join(c if c.isalnum() else " " * len(c.encode()) for c in text).lower().encode() + b" "
        two = [(padded[p] << 8) + padded[p + 1] for p in range(len(padded) - 1)]
        three = [(two[p] << 8) + padded[p + 2] for p in range(len(padded) - 2)]
        m = (1 << 32) - 1
        for g in two:
            if g != 0x2020:
                yield (g * 0x9E3779B1 & m) >> 20
        for g in three:
            if g & 0xFFFF00 != 0x202000:
                yield ((((g * 0x85EBCA77 & m) ^ (g >> 7)) * 0xC2B2AE3D) & m) >> 20

    held = [0] * (1 << op6_language.BITS)
    for _, t, _ in seen:
        for g in set(grams(t)):
            held[g] += 1
    assert model.idf == pytest.approx([np.log((1 + len(seen)) / (1 + h)) + 1 for h in held], rel=1e-5)
    for r in op6_language.identified(x, model).collect():
        tf = {}
        for g in grams(rows[r["doc_id"]][1]):
            tf[g] = tf.get(g, 0) + 1
        v = {g: np.log1p(c) * model.idf[g] for g, c in tf.items()}
        norm = np.sqrt(sum(a * a for a in v.values()))
        cosine = [sum(a * c[g] for g, a in v.items()) / norm for c in model.rows]
        assert r["score"] == pytest.approx(max(cosine), abs=1e-5)
        assert r["lang_pred"] in [str(model.lang[k]) for k, c in enumerate(cosine) if c > max(cosine) - 1e-5]


def test_language_of_repeated_and_long_rows(spark):
    rows = [(i % 10, "the cat and the dog in the house" if i % 2 else "der Hund und die Katze im Haus", "en" if i % 2 else "de") for i in range(40)] + [(None, "the dog", "en"), (77, "das Haus und der Hund " * 100000, None), (78, "◌́ 12", "en"), (79, "½ ²", "de")]
    x = spark.createDataFrame([(*r, 9, 0.1, True) for r in rows], "doc_id bigint, text string, lang string, lang_pred int, score double, held_out boolean")
    out = op6_language.identified(x, op6_language.train(x)).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], set()).add((r["lang_pred"], round(r["score"], 5)))
    assert {k: {p for p, _ in v} for k, v in got.items()} == {**{i: {"en" if i % 2 else "de"} for i in range(10)}, None: {"en"}, 77: {"de"}, 78: {"und"}, 79: {"und"}}
    assert all(len(v) == 1 for v in got.values())


def test_packing_of_ties_and_repeated_rows(spark):
    rows = [(i, "one two three four five six seven") for i in range(500)] + [(7, "one two three four five six seven")] * 20 + [(None, None), (None, ""), (900, "word " * 30000)]
    x = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id bigint, text string, piece int, offset long").repartition(3)
    out = packed(x).collect()
    assert len([r for r in out if r["doc_id"] != 900]) == 522
    assert len([r for r in out if r["doc_id"] == 7]) == 21
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert len(used) == brute.fewest([r["length"] for r in out], 2048)
    long = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 900)
    assert [p for p, _, _ in long] == list(range(len(long)))
    assert all(start == 2048 * p for p, start, _ in long)
    assert all(n == 2048 for _, _, n in long[:-1])


# 8: decontamination.


def plain_score(words, item):
    """Smith and Waterman's table, cell by cell."""
    best, above = 0.0, [0.0] * (len(words) + 1)
    for w in item:
        row = [0.0]
        for j, x in enumerate(words, 1):
            row.append(max(0.0, above[j - 1] + (1 if x == w else -0.5), above[j] - 0.5, row[j - 1] - 0.5))
        best, above = max(best, *row), row
    return best


def edited_copy(rng, item, share):
    """Some words changed, some taken out, some put in."""
    out = []
    for w in item:
        if rng.random() >= share:
            out.append(w)
        else:
            out += rng.choice([[], [f"new{rng.randrange(99)}"], [w, f"new{rng.randrange(99)}"]])
    return out


def test_contaminated_against_all_alignments(spark):
    rng = random.Random(6)
    w = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(3)) for _ in range(n)]
    items = [(k, w(rng.randrange(1, 22))) for k in range(9)]
    docs = [(i, w(rng.randrange(40)) + edited_copy(rng, items[i % 9][1], rng.choice([0, 0.1, 0.3, 0.5])) + w(rng.randrange(40))) for i in range(60)]
    want = {}
    for i, d in docs:
        for k, t in items:
            s = plain_score(d, t)
            if s >= max(0.5 * len(t), min(len(t), 4)) - 1e-9:
                want[i, k] = s / len(t)
    x = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], DOCS)
    y = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(x, y, block_bytes=80).collect()}
    assert got == pytest.approx(want)


def test_recall_of_edited_copies(spark):
    """At 5, 15 and 25 % of the words."""
    rng = random.Random(7)
    w = lambda n: [f"v{int(3000 * rng.random() ** 3)}" for _ in range(n)]
    items = [(k, w(40)) for k in range(20)]
    docs = [(1000 * n + k, w(200) + edited_copy(rng, t, share) + w(100)) for n, share in enumerate((0.05, 0.15, 0.25)) for k, t in items] + [(9000 + k, w(300)) for k in range(20)]
    x = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], DOCS)
    y = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(x, y).collect()}
    for n in range(3):
        assert sum((1000 * n + k, k) in got for k in range(20)) >= 18
    assert not [1 for i, _ in got if i >= 9000]


def test_contaminated_in_a_very_long_text_and_typographic_quotes(spark):
    item = "what is the name of the long river that flows through the old town"
    x = spark.createDataFrame([(1, "word " * 200000 + item), (2, "“" + item.replace(" ", "” “") + "”…")], DOCS)
    y = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["score"]) for r in contaminated(x, y).collect()) == [(1, 1.0), (2, 1.0)]



def plain_alignment(passage, item):
    best, before = 0.0, [0.0] * (len(passage) + 1)
    for w in item:
        row = [0.0]
        for j, p in enumerate(passage, 1):
            row.append(max(0.0, before[j - 1] + (1.0 if p == w else -0.5), before[j] - 0.5, row[j - 1] - 0.5))
        best, before = max(best, *row), row
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=12))
def test_alignment(a, b):
    score, begin, end = align(np.array(a, np.uint64), np.array(b, np.uint64))
    assert score == pytest.approx(plain_alignment(a, b))
    if score:
        assert plain_alignment(a[begin:end], b) == pytest.approx(score)


def test_contaminated(spark):
    rng = random.Random(1)
    w = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, w(20)) for k in range(6)] + [(6, ["short", "item"])]
    edited = list(items[1][1])
    edited[10] = "changed"
    del edited[14]
    docs = [(1, w(100) + items[0][1] + w(50)), (2, w(30) + edited), (3, w(300)), (4, items[2][1][:6] + w(40)), (5, ["A", "SHORT,", "Item!"]), (6, [])]
    x = spark.createDataFrame([(i, " ".join(t)) for i, t in docs] + [(7, None), (1, " ".join(docs[0][1]))], DOCS)
    y = spark.createDataFrame([(k, " ".join(t), 0) for k, t in items] + [(8, None, 0), (None, "x", 0)], "item_id bigint, text string, doc_id int")
    for blocks in ({}, {"block_bytes": 100}):
        got = {(r["doc_id"], r["item_id"]): r for r in contaminated(x, y, **blocks).collect()}
        assert {*got} == {(1, 0), (2, 1), (5, 6)}
    assert (got[1, 0]["score"], got[1, 0]["first_word"], got[1, 0]["end_word"]) == (1.0, 100, 120)
    assert sorted(r["doc_id"] for r in decontaminate(x, y).collect()) == [3, 4, 6, 7]
    assert contaminated(x.limit(0), y).count() == contaminated(x, y.limit(0)).count() == 0


def test_edited_copy_beside_an_exact_one(spark):
    item = [f"v{k}" for k in range(40)]
    edited = [f"x{k}" if k % 7 == 6 else w for k, w in enumerate(item)]
    x = frame(spark, [(1, " ".join(["a", *item])), (2, " ".join(["b", *edited])), (3, "nothing of it")])
    y = spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in contaminated(x, y).collect()}
    assert got == {1: 1.0, 2: pytest.approx((35 - 5 * 0.5) / 40)}


def test_copies_with_dense_edits(spark):
    rng = random.Random(4)
    item = [f"v{k}" for k in range(40)]
    fourth = [f"x{k}" if k % 4 == 3 else w for k, w in enumerate(item)]
    apart = [x for k, w in enumerate(item) for x in (w, f"y{k}")]
    few = [[f"w{rng.randrange(9)}" for _ in range(12)] for _ in range(4)]
    docs = [["a"] * 30 + fourth + ["b"] * 30, ["a"] * 30 + apart + ["b"] * 30] + [[f"w{rng.randrange(14)}" for _ in range(rng.randrange(30))] for _ in range(40)]
    items = [item, *few]
    x = frame(spark, [(i, " ".join(t)) for i, t in enumerate(docs)])
    y = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(x, y).collect()}
    plain = {(i, k): plain_alignment(t, item) / len(item) for i, t in enumerate(docs) for k, item in enumerate(items)}
    assert {(0, 0), (1, 0)} <= {*got}
    assert got == pytest.approx({pair: s for pair, s in plain.items() if s >= 0.5})


def test_items_that_share_an_id(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcd"]
    x = frame(spark, list(enumerate(texts)))
    y = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (None, texts[2]), (7, texts[0])], "item_id bigint, text string")
    for blocks in ({}, {"block_bytes": 50}):
        assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(x, y, **blocks).collect()) == [(0, 7), (1, 7), (2, None)]
        assert [r["doc_id"] for r in decontaminate(x, y, **blocks).collect()] == [3]


@tables
def test_op8_finds_whole_items(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op8_decontamination.op8_decontamination(spark, SF).collect()}
    assert {(i, k) for i, t in texts for k, item in items if t and item in t} <= got


# 1: conversations, 7: licences.


def test_reply_order(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?"),
        (1, 1, "user", "What about sets?"),
        (1, 2, "bot", "On Monday X wrote:\n> how do I  SORT a list?\nUse sorted."),
        (1, 3, "user", "> Use sorted.\n> > How do I sort a list?\nThanks"),
        (1, 4, "bot", "> What about sets?\nThey have no order."),
        (2, 0, "user", None), (2, 1, "user", ""), (2, 2, "bot", "> never said\nok"), (None, 1, "user", "x"), (3, None, "user", "> x"),
    ]
    x = spark.createDataFrame(rows + rows[-3:-2], "conv_id bigint, turn bigint, role string, text string").withColumn("body", F.lit(1)).withColumn("Position", F.lit(2))
    out = conversations(x).collect()
    assert len(out) == 11
    one = {r["turn"]: r for r in out if r["conv_id"] == 1}
    assert [one[t]["parent_turn"] for t in range(5)] == [None, None, 0, 2, 1]
    assert [one[t]["position"] for t in range(5)] == [0, 3, 1, 2, 4]
    assert [one[t]["thread_turn"] for t in range(5)] == [0, 1, 0, 0, 1]
    assert [one[t]["depth"] for t in range(5)] == [0, 0, 1, 2, 1]
    assert one[2]["body"] == "Use sorted."
    assert one[3]["n_quoted"] == 2
    assert sorted(r["position"] for r in out if r["conv_id"] == 2) == [0, 1, 2, 3]
    assert conversations(x.limit(0)).count() == 0


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        ("a/LICENSE", f"Notice\n{mit}"), ("a/x.py", "print(1)"), ("a/b/y.py", "# SPDX-License-Identifier: Apache-2.0\ncode"), ("a/b/z.py", None), ("a/b/COPYING", "Licensed under the GNU General Public License, version 2"),
        ("c/x.py", "this text is licensed to nobody in particular and says so at length"), ("top.py", ""), (None, mit), ("a/x.py", "print(1)"),
    ]
    x = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit(1)).withColumn("File", F.lit("q"))
    out = [(r["path"], r["license"], r["origin"], r["from_dir"]) for r in scan_licenses(x).collect()]
    got = dict((p, (a, b, c)) for p, a, b, c in out)
    assert len(out) == 9
    assert got["a/LICENSE"] == ("MIT", "own", None)
    assert got["a/x.py"] == ("MIT", "inherited", "a")
    assert got["a/b/y.py"] == ("Apache-2.0", "own", None)
    assert got["a/b/z.py"] == ("GPL-2.0", "inherited", "a/b")
    assert got["c/x.py"] == (None, "none", None)
    assert got["top.py"] == (None, "none", None)
    assert got[None] == ("MIT", "own", None)
    assert scan_licenses(x.limit(0)).count() == 0


def test_common_words_beside_a_licence_weigh_little(spark):
    header = "Released under the MIT License, see the readme of our package for more details and help"
    plain = spark.range(2000).select(F.concat(F.lit("docs/"), "id").alias("path"), F.lit("see the readme of our package for more details and help").alias("text"))
    x = plain.union(spark.createDataFrame([("a/x.py", header), ("a/y.py", "our license plate reader needs quartz glyphs")], "path string, text string"))
    got = {r["path"]: r["license"] for r in scan_licenses(x).collect() if r["license"]}
    assert got == {"a/x.py": "MIT"}
