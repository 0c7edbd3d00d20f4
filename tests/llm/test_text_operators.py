"""Corpus operators on texts against brute force, and their edge cases."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelith.llm import decontam, linededup, packing, simhash, textkit
from voxelith.operators.graph import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", simhash string, component_id string, n_lines string, contamination string, kept_id string, gone string, score string, findings string"


def rows(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def clashing(df):
    for c in CLASH.split(", ")[1:]:
        name, kind = c.split(" ")
        df = df.selectExpr("*", f"cast('x' as {kind}) as {name}")
    return df


# --- hashing ---------------------------------------------------------------------------------------


def test_hash_is_the_same_in_any_batch():
    texts = [b"", b"a", b"Abc abc, xyz!", "é ß ñandú 漢字".encode(), b"x" * 3000 + b" y", b"  \n "]
    one = textkit.Words(texts, textkit.ALNUM, fold=True)
    for i, t in enumerate(texts):
        alone = textkit.Words([t], textkit.ALNUM, fold=True)
        assert one.hashes[one.cuts[i] : one.cuts[i + 1]].tolist() == alone.hashes.tolist()
        assert len(alone.hashes) == len(decontam.word_list(t))
    b = np.frombuffer(b"ab " * 1000, np.uint8)
    s, e = textkit.spans(b)
    assert len(set(textkit.hash_spans(b, s, e, step=7).tolist())) == 1


def test_winnow_keeps_a_minimum_of_each_window():
    g = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    kept = set(textkit.winnow(g, 6).tolist())
    for at in range(len(g) - 5):
        low = g[at : at + 6].min()
        assert any(p in kept and g[p] == low for p in range(at, at + 6))
    assert textkit.winnow(np.zeros(0, np.uint64), 6).tolist() == []


# --- SimHash --------------------------------------------------------------------------------------------


def plain_simhash(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_by_hand():
    for t in (None, "", " \n", "One", "one two", "A b c d e A b c", "é\xa0É x y z", words(3, 200)):
        assert simhash.simhash(None if t is None else t.encode(), 3, 42) == plain_simhash(t, 3)


def brute_components(fps, limit=2):
    n = len(fps)
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(n), 2):
        if (fps[a] ^ fps[b]).bit_count() <= limit:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(a) for a in range(n)]


def test_block_pivots_determine_the_block():
    for width in simhash.WIDTHS[1:]:
        p = simhash.block_pivots(width)
        assert len({tuple((x ^ y).bit_count() - x.bit_count() for y in p) for x in range(1 << width)}) == 1 << width


@pytest.mark.parametrize(("split", "distance"), [(64, 2), (3, 2), (3, 1)])
def test_links_are_those_of_brute_force(spark, split, distance):
    rng = random.Random(5)
    fps = []
    for _ in range(25):  # chains and clusters of flips, one of them large
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 4, 30])):
            fps.append(x)
            for _ in range(rng.choice([0, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    fps = sorted(set(fps) | {0, (1 << 64) - 1, 1, 3})
    centre = rng.getrandbits(64)  # a dense bucket: all neighbours of one fingerprint, and two blocks filled at random
    fps = sorted({*fps, *(centre ^ (1 << i) for i in range(64)), *(centre ^ rng.getrandbits(24) for _ in range(150))})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    edges, _ = simhash.links(df, distance, split)
    got = {(r["u"] & ((1 << 64) - 1), r["v"] & ((1 << 64) - 1)) for r in edges.collect()}
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= distance}
    assert {tuple(sorted(x)) for x in got} == want


def test_pivot_keys_stay_short_as_code(spark, tmp_path):
    """Written out, the pivots made 16,000 lines that no longer compiled, and most of the driver's memory went into them."""
    path = str(tmp_path / "fps")
    spark.range(100).select(F.xxhash64("id").alias("fp")).write.parquet(path)
    ws = [f"w{i}" for i in range(simhash.WIDE)]
    keyed = simhash.pivot_table(spark.read.parquet(path)).select("fp", *ws, F.inline("keys"))
    code = spark._jvm.PythonSQLUtils.explainString(keyed._jdf.queryExecution(), "codegen")
    assert len(code.splitlines()) < 3000
    assert keyed.count() == 600
    # the bits outside the two blocks come along
    got = keyed.collect()
    block = lambda fp, b: fp >> 16 * b & 0xFFFF
    for r in got:
        a, b = list(itertools.combinations(range(4), 2))[r["pair"]]
        c, d = (x for x in range(4) if x not in (a, b))
        assert r["rest"] == block(r["fp"], c) | block(r["fp"], d) << 16


def test_components_of_fingerprints(spark):
    rng = random.Random(6)
    texts = [words(i // 3, 80) + (" end" * rng.randrange(2)) for i in range(60)]
    got = {r[0]: r[2] for r in simhash.near_duplicates(spark.createDataFrame(rows(texts), DOC), shingle=3).collect()}
    assert [got[i] for i in range(60)] == brute_components([plain_simhash(t, 3) for t in texts])


def test_different_texts_of_one_id_both_stay(spark):
    a, b, c = words(1, 60), words(2, 60), words(3, 60)
    df = spark.createDataFrame([(7, a, "p"), (7, b, "q"), (7, b, "q"), (8, a, "r"), (9, c, "s"), (None, c, "t"), (10, None, "u"), (10, "", "v")], "doc_id long, text string, kept_text string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(7, a), (7, b), (9, c), (0, c), (10, "")])


def test_near_duplicates_and_edge_cases(spark):
    base = words(1, 300)
    texts = [base, base, base.replace(" ", "  "), base + " end", words(2, 300), None, "", "short", base.upper()]
    docs = clashing(spark.createDataFrame([*rows(texts), (None, base, None, None, None), (4, texts[4], "en", "s", 1)], DOC))
    got = [(r[0], r[1], r[2]) for r in simhash.near_duplicates(docs, shingle=3).collect()]
    assert len(got) == len(texts) + 2
    by = {d: (f, c) for d, f, c in got}
    fps = [plain_simhash(t, 3) for t in texts]
    want = brute_components(fps)
    assert all(by[i] == (simhash._signed(fps[i]), want[i]) for i in range(len(texts)))
    assert by[None][1] == 0
    kept = simhash.keep_one(docs, shingle=3)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want)) and ids.count(None) == 1
    assert kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_of_a_long_chain(spark):
    n = 60
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (100, 101), (101, 100)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}
    assert connected_components(e.limit(0)).count() == 0


# --- packing ----------------------------------------------------------------------------------------------


def test_tournament_is_first_fit():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    room, want = [], []
    for s in sizes:
        b = next((i for i, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(100)
        want.append((b, 100 - room[b]))
        room[b] -= s
    assert packing.first_fit_decreasing(sizes, 100) == want
    assert packing.first_fit_decreasing([], 100) == []


def test_encoder_gives_the_ids_of_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), packing.encoder(path)
    texts = ["", " ", "Hello  world's\n\n end", "ñandú écoute ß 漢字 🙂‍↔️ \u200d", "x" * 500, "a <|endoftext|> b", "\t\r\n \x00 0123456789", words(8, 100)]
    for x in texts:
        assert e.ids(x) == t.encode(x, add_special_tokens=False).ids


def test_long_runs_of_one_character_are_encoded():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), packing.encoder(path)
    for c, n in ((" ", 1_100_000), ("\u3000", 1_100_000), ("\n", 200_000), ("a", 200_000), ("-", 200_000)):
        x = "One " + c * n + "b <|endoftext|>"
        assert e.ids(x) == t.encode(x, add_special_tokens=False).ids
    assert not packing.long_space(" " * 49_999) and packing.long_space("ab" + " " * 100_000 + "c")


def test_packing_keeps_every_id_once(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [words(i, 5 + 40 * i) for i in range(40)] + [None, "", words(99, 3000)]
    docs = clashing(spark.createDataFrame([*rows(texts), (None, "a b", None, None, None), (3, texts[3], "", "", 0)], DOC))
    out = [r.asDict() for r in packing.pack_documents(docs, path, capacity=256, group_size=20, with_ids=True).collect()]
    t = Tokenizer.from_file(path)
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    for i, x in enumerate(texts):
        mine = sorted((r["start"], r["ids"]) for r in out if r["doc_id"] == i)
        mine = mine[::2] if i == 3 else mine
        ids = [v for _, part in mine for v in part]
        assert ids == [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert all(r["doc_tokens"] == len(ids) for r in out if r["doc_id"] == i)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert sum(r["length"] for r in out) / (256 * len(seqs)) > 0.9
    assert packing.pack_documents(docs.limit(0), path).count() == 0


# --- decontamination ------------------------------------------------------------------------------------------


def brute_hits(text, items, span=10):
    w = decontam.word_list((text or "").encode())
    hit, found = set(), set()
    for i, t in items:
        x = decontam.word_list((t or "").encode())
        n = min(span, len(x))
        if n:
            grams = {tuple(x[p : p + n]) for p in range(len(x) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_decontamination_against_brute_force(spark, block_words):
    rng = random.Random(4)
    vocab = ["a", "b", "c", "Dé", "e1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 7, 9, 10, 11, 30])))) for i in range(12)] + [(50, None), (51, ""), (52, "!!")]
    texts = []
    for i in range(40):
        t = [rng.choice([*vocab, "zz"]) for _ in range(rng.choice([0, 4, 9, 10, 60, 200]))]
        if i % 3 == 0:
            t[5:5] = items[i % 12][1].upper().replace("É", "é").split()
        texts.append(rng.choice([" ", ", ", "\n"]).join(t))
    texts += [None, "", "b"]
    docs = clashing(spark.createDataFrame(rows(texts), DOC))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    out = {r["doc_id"]: r for r in decontam.contamination(docs, bench, into="c", block_words=block_words).select("doc_id", "c", decontam.n_hit("c").alias("n")).collect()}
    for i, t in enumerate(texts):
        assert (out[i]["c"]["n_words"], out[i]["n"], out[i]["c"]["items"]) == brute_hits(t, items), i
    clean = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()}
    assert clean == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == len(texts)


# --- line dedup ----------------------------------------------------------------------------------------------------


def test_rising_is_a_longest_rising_run():
    rng = random.Random(1)
    for _ in range(50):
        v = [rng.randrange(12) for _ in range(9)]
        got = [v[i] for i in linededup.rising(v)]
        assert all(a < b for a, b in zip(got, got[1:], strict=False))
        best = max(len(c) for n in range(10) for c in itertools.combinations(v, n) if all(a < b for a, b in zip(c, c[1:], strict=False)))
        assert len(got) == best


def brute_dedup(texts, min_words=20):
    """All pairs of line pairs, one earlier owner each; longest common rising run by dynamic programming."""
    cut = []
    for t in texts:
        x = linededup.Lines([(t or "").encode()])
        keys, _ = x.pairs()
        cut.append((keys.tolist(), x.words.tolist(), x.start.tolist()))
    out = []
    for d, (keys, size, start) in enumerate(cut):
        owners = {}
        for p, k in enumerate(keys):
            o = next((e for e in range(d) if k in cut[e][0]), None)
            if o is not None:
                owners.setdefault(o, []).append((cut[o][0].index(k), p))
        cover = set()
        for pairs in owners.values():
            best = [1] * len(pairs)
            back = [-1] * len(pairs)
            for b in range(len(pairs)):
                for a in range(b):
                    if pairs[a][0] < pairs[b][0] and best[a] + 1 > best[b]:
                        best[b], back[b] = best[a] + 1, a
            at = max(range(len(pairs)), key=best.__getitem__)
            while at >= 0:
                p = pairs[at][1]
                cover |= {p, p + 1} if p + 1 < len(keys) else {p}
                at = back[at]
        gone = set()
        for p in sorted(cover):
            if p - 1 not in cover:
                run = [p]
                while run[-1] + 1 in cover:
                    run.append(run[-1] + 1)
                if sum(size[q] for q in run) >= min_words:
                    gone |= set(run)
        raw = (texts[d] or "").encode()
        ends = [*start[1:], len(raw)]
        start = [0, *start[1:]] if start else []
        kept = b"".join(raw[s:e] for p, (s, e) in enumerate(zip(start, ends, strict=True)) if p not in gone) if start else raw
        out.append(kept.decode() if texts[d] is not None else None)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(7)
    sent = lambda: words(rng.random(), rng.randint(3, 12)).capitalize() + "."
    passage = [sent() for _ in range(8)]
    common = "A very common line."
    docs = [[sent() for _ in range(12)] for _ in range(8)]
    docs[3][4:4] = passage
    docs[5][2:2] = passage
    docs[7][9:9] = passage[2:7]
    for d in docs:
        d.insert(5, common)
    docs.append(docs[2][:])
    docs.append([docs[2][0], sent(), *docs[2][2:]])
    texts = ["\n".join(" ".join(d[i : i + 3]) for i in range(0, len(d), 3)) for d in docs] + [None, "", "\n \n", "one line " * 60]
    texts.append(texts[-1])
    df = clashing(spark.createDataFrame(rows(texts), DOC))
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_dedup(texts)
    assert got[8] == "" and got[4] == texts[4] and got[0] == texts[0]
    assert passage[3] in got[3] and passage[3] not in got[5]
    again = [*rows(texts), rows(texts)[2], (None, texts[2], None, None, None)]
    twice = linededup.dedup_lines(spark.createDataFrame(again, DOC), counts=True).collect()
    assert sorted(r["text"] or "" for r in twice if r["doc_id"] in (2, None)) == sorted([texts[2]] * 3)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    a = " ".join(words(i, 9).capitalize() + "." for i in range(6))
    b = " ".join(words(i + 50, 9).capitalize() + "." for i in range(6))
    df = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted(r["text"] for r in linededup.dedup_lines(df).collect()) == sorted([a, "", b])


def spans_left(before, after, n=50):
    """Windows of ``n`` words that a later text kept although an earlier text has them word for word; lines play no part."""
    windows = lambda t: [tuple(w[i : i + n]) for w in [t.split()] for i in range(len(w) - n + 1)]
    seen, left, shared = set(), [], 0
    for b, a in zip(before, after, strict=True):
        shared += sum(x in seen for x in windows(b))
        left += [x for x in windows(a) if x in seen]
        seen.update(windows(b))
    return shared, left


def deduped(spark, texts):
    out = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r["text"] for r in out.orderBy("doc_id").collect()]


def test_a_shared_line_is_found_between_different_neighbours(spark):
    """One long sentence, one line of a paragraph, or one whole sentence with parts of two others."""
    rng = random.Random(11)
    body = lambda n: words(rng.random(), n)
    own = lambda: " ".join(body(rng.randint(4, 14)).capitalize() + "." for _ in range(4))
    texts = []
    for n in (50, 51, 60, 75, 93):
        sentence, line, parts = body(n).capitalize() + ".", body(n), f"{body(n // 3)}. {body(n - 2 * (n // 3)).capitalize()}. {body(n // 3)}"
        for _ in range(2):
            texts += [f"{own()} {sentence} {own()}", f"{own()}\n{line}\n{own()}", f"{body(9)} {parts} {body(9)}."]
    shared, left = spans_left(texts, deduped(spark, texts))
    assert shared >= 5 * 3 and not left


def test_lines_do_not_depend_on_the_other_texts_of_a_batch():
    raws = [words(i, n).encode() for i, n in enumerate((3, 40, 1, 200, 15, 16, 17, 0, 90))]
    whole = linededup.Lines(raws)
    assert whole.words.tolist() == [n for r in raws for n in linededup.Lines([r]).words.tolist()]


@pytest.mark.parametrize("kind", ["plain", "cjk", "list", "frequent"])
def test_a_shared_passage_without_ascii_ends_is_found(spark, kind):
    """50 to 200 words in the middle of a line that has no full stop, exclamation or question mark."""
    rng = random.Random(kind)

    def body(n):
        if kind == "frequent":
            return " ".join(rng.choices([words(i, 1) for i in range(60)], [1 / (i + 1) for i in range(60)], k=n))
        w = words(rng.random(), n).split()
        return " ".join(x + "。" if kind == "cjk" and i % 9 == 8 else f"{x}\n-" if kind == "list" and i % 7 == 6 else x for i, x in enumerate(w))

    texts = []
    for n in (50, 51, 80, 100, 200):
        for _ in range(3):
            passage = body(n)
            texts += [f"{body(rng.randint(5, 40))} {passage} {body(rng.randint(5, 40))}" for _ in range(2)]
    shared, left = spans_left(texts, deduped(spark, texts))
    assert shared >= 3 * (1 + 2 + 31 + 51 + 151) and not left


def test_blocks_in_another_order_go_too(spark):
    p, q, r = (" ".join(words(100 * i + j, 9).capitalize() + "." for j in range(n)) for i, n in enumerate((6, 5, 4)))
    own = words(77, 12).capitalize() + "."
    few = " ".join(p.split()[:18])
    assert deduped(spark, [f"{p} {q} {r}", f"{r} {q} {p}", f"{r} {q} {p}", f"{q} {own} {r} {own} {few}"]) == [f"{p} {q} {r}", "", "", f"{own} {own} {few}"]
