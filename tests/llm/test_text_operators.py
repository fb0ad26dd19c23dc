"""Quality rules, SimHash, packing: against brute force."""
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import numtext as nt
from quarry.llm import decontam, packing, quality, simhash
from quarry.llm.queries import tokenizer_path
from tests.llm.helpers import documents, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mirrored_words(doublings=10):
    """Two words of two letters that hash alike modulo a power of two, whatever the base."""
    swap = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(doublings):
        word += word.translate(swap)
    return word, word.translate(swap)


def test_mirrored_words_are_two_lines_and_two_parts():
    one, two = mirrored_words()
    lines = f"{one} x\n{two} x\n" * 2
    for _, _, buf, offs in nt.slices(pa.array([lines])):
        assert quality.measures(buf, offs)["n_dup_lines"][0] == 2
    tokens = packing.TextTokens(tokenizer_path())
    texts = [f"{one} {two}", two]
    for _, _, buf, offs in nt.slices(pa.array(texts)):
        ids, n = tokens(buf, offs)
    want = [tokens.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == want[0] + want[1] and n.tolist() == list(map(len, want))


def test_hash_arithmetic_equals_whole_numbers():
    rnd = random.Random(3)
    p = nt.PRIME
    a = [0, 1, p - 1, p - 1, *(rnd.randrange(p) for _ in range(3000))]
    b = [5, p - 1, p - 1, 1, *(rnd.randrange(p) for _ in range(3000))]
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert nt._times(x, y).tolist() == [i * j % p for i, j in zip(a, b)]
    total = [0]
    for i in a:
        total.append((total[-1] + i) % p)
    assert nt._sums(x).tolist() == total
    up, down = nt.powers(nt.BYTE_BASE, 70_000)
    assert int(up[-1]) == pow(nt.BYTE_BASE, 69_999, p) and int(up[-1]) * int(down[-1]) % p == 1
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(500)) * 2, np.uint8)
    i = np.arange(0, 400, 7)
    halves, plain = nt.byte_hash(data), nt.prefix_hash(data.astype(np.uint64) + np.uint64(1), nt.BYTE_BASE)
    h = nt.span_hash(halves, i, i + 90, nt.BYTE_BASE)
    assert (h == nt.span_hash(plain, i, i + 90, nt.BYTE_BASE)).all() and (h == nt.span_hash(halves, i + 500, i + 590, nt.BYTE_BASE)).all()


# -- quality ---------------------------------------------------------------

def test_rules_equal_sql(spark):
    docs = documents(spark)
    got = quality.repetition_rules(docs).drop("n_lines")
    same(got, quality.oracle_sql(), {"documents": docs.toDF(
        *[f"c{k}" if k > 1 else n for k, n in enumerate(docs.columns)])})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n#é", max_size=60), max_size=6))
def test_repeated_windows(texts):
    for _, _, buf, offs in nt.slices(pa.array(texts, pa.string())):
        m = quality.measures(buf, offs)
        for k, t in enumerate(texts):
            ws = WORD.findall(t)
            assert m["n_words"][k] == len(ws) and m["word_chars"][k] == sum(map(len, ws))
            for n in quality.MAX_COVERAGE:
                grams = [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)]
                inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)}
                assert m[f"dup_{n}_chars"][k] == sum(len(ws[j]) for j in inside)
                if n == 5:
                    assert m["n_repeat_words"][k] == len(inside)
            lines = [x for x in t.split("\n") if WORD.search(x)]
            assert m["n_dup_lines"][k] == len(lines) - len(set(lines))
            assert m["n_symbols"][k] == len(re.findall(r"[#*$%&|<>]", t))


def test_verdict_uses_the_coverage(spark):
    same10 = " ".join(f"w{i}" for i in range(12))
    fresh = " ".join(f"v{i}" for i in range(120))
    rows = [(1, f"{fresh} {same10} {same10}"), (2, fresh), (3, f"{fresh}\n" + "line of text\n" * 30)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.repetition_rules(documents(spark, rows)).collect()}
    assert got[2] == (False, True)
    assert got[1] == (False, False)     # 24 of 144 words are below the base's bound, their characters above the method's
    assert not got[3][1]


# -- SimHash ---------------------------------------------------------------

def fingerprint(text, k=3):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(fps, radius):
    """Union-find over all pairs: index -> smallest index reachable."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_fingerprints_and_classes(spark):
    docs = documents(spark)
    rows = [(r[0], r[1]) for r in docs.collect()]
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [fingerprint(t) for _, t in rows]
    cls = classes(fps, 2)
    expected = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if cls[j] == cls[k] and rows[j][0] is not None]
        expected.append((i or -1, format(fps[k], "016x"), min(ids, default=None)))
    assert got == sorted(expected)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_links_equal_brute_force(radius):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(40)]
    while len(fps) < 300:
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    f = np.array(sorted(set(fps)), np.uint64)
    a, b = simhash.bucket_links(np.zeros(len(f), np.int64), f, radius)
    got = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())}
    assert len(got) == len(a)
    assert got == {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if (int(f[i]) ^ int(f[j])).bit_count() <= radius}


def test_large_buckets_are_cut_without_loss(spark):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:       # a cloud of near copies that share most blocks
        x = rng.choice(list(fps)) if rng.random() < 0.5 else base
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    values = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.u: r.root for r in simhash.components(simhash.link_stars(values, 2, bucket=16)).collect()}
    got = [roots.get(x, x) for x in signed]
    cls = classes(fps, 2)
    assert len(set(zip(got, cls))) == len(set(got)) == len(set(cls))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    got = {r.u: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + k: 1000 for k in range(1, 300)}}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- packing ---------------------------------------------------------------

def test_lengths():
    assert packing.lengths(1, 8) == [1] and packing.lengths(8, 8) == [8] and packing.lengths(21, 8) == [8, 8, 4, 1]
    for n in range(1, 300):
        assert sum(packing.lengths(n, 16)) == n


def test_pieces_hold_every_id(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    odd = [(20, "it's don't-STOP!!'re 3.5€ \x00 a\x1cb"), (21, "<|endoftext|> and <|startoftext|>x"), (22, "É À ÿ × ÷ Þß ΣΑΣ İ ﬁ é É"),
           (23, "mixed12ab34  nbsp em\x85nel 日本語テスト"), (24, "''s 'll ' a'b")]
    docs = documents(spark, [*documents_rows(), *odd])
    rows = [(r[0], r[1]) for r in docs.collect()]
    pieces = packing.pack(docs, tokenizer_path()).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    by_doc = {}
    for p in pieces:
        assert p.offset == 0 and len(p.ids) == 4 * p.length and p.length & (p.length - 1) == 0 and p.length <= 4096
        by_doc.setdefault(p.doc_id, []).append(p)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda p: (p.start, p.sequence_id))
        copies = sum(j == i for j, _ in rows)
        assert len(own) == copies * len(packing.lengths(len(ids)))
        at = 0
        for p in own[::copies]:
            assert p.start == at and p.doc_tokens == len(ids)
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[at:at + p.length]
            at += p.length
        assert at == len(ids)
    for batch in {p.batch_id for p in pieces}:
        assert len({p.length for p in pieces if p.batch_id == batch}) == 1
    assert zlib.crc32(pieces[0].ids) >= 0


def documents_rows():
    from tests.llm.helpers import TEXTS
    return TEXTS


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_tokens_equal_the_library(texts):
    t = packing.text_tokens(tokenizer_path())
    for i, _, buf, offs in nt.slices(pa.array(texts, pa.string())):
        ids, n = t(buf, offs)
        ends = np.cumsum(n)
        for k, text in enumerate(texts):
            assert ids[ends[k] - n[k]:ends[k]].tolist() == t.whole.encode(text, add_special_tokens=False).ids


MARKED = ["<|endoftext|>", "a <|endoftext|> and <|startoftext|>x", "x<|startoftext|><|endoftext|>y's", "<|ENDOFTEXT|> it's<|EndOfText|>", "<|endoftext|>é 日<|endoftext|>本",
          "<|ENDOFTEXT|><|endoftext|>B", "no mark <|endof text|>", "", "A\x85<|endoftext|>\u00a0B"]


def test_marks_of_added_tokens_equal_the_plain_library(tmp_path, spark):
    from tokenizers import Tokenizer
    from quarry.llm.queries import op10_binary_packing
    tok = Tokenizer.from_file(tokenizer_path())
    plain = [tok.encode(t, add_special_tokens=False).ids for t in MARKED]
    assert 49407 in plain[0] and 49406 in plain[1]
    t = packing.text_tokens(tokenizer_path(), added=True)
    for _ in range(2):      # learned, then remembered
        for i, _, buf, offs in nt.slices(pa.array(MARKED, pa.string())):
            ids, n = t(buf, offs)
            ends = np.cumsum(n)
            assert [ids[e - k:e].tolist() for e, k in zip(ends, n)] == plain
    spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.start): r.ids_crc32 for r in op10_binary_packing(spark, str(tmp_path)).collect()}
    expected = {}
    for k, ids in enumerate(plain):
        ids, at = [*ids, 2], 0
        for size in packing.lengths(len(ids)):
            expected[k, at] = zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes())
            at += size
    assert got == expected


def test_word_hashes_are_the_polynomial_of_their_bytes():
    words = [b"a", b"zz", b"\xc3\xb1andu", b"x" * 300]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    got = nt.words(buf, np.array([0, len(buf)])).hashes()
    want = [sum((b + 1) * pow(nt.BYTE_BASE, k, nt.PRIME) for k, b in enumerate(w)) % nt.PRIME for w in words]
    assert (got == nt.mix(np.array(want, np.uint64))).all()
    some = [0, 1, (1 << 30) - 1, 1 << 30, nt.PRIME - 1]
    assert nt._up31(np.array(some, np.uint64)).tolist() == [x * 2**31 % nt.PRIME for x in some]


def test_decontamination_reads_texts_in_pieces_that_fit_a_cache():
    texts = ["w%d and some more words\n" % i * 400 for i in range(200)] + ["", "long " * 200_000]
    column = pa.array(texts)
    pieces = list(nt.slices(column, decontam.PIECE_BYTES))
    assert [i for i, _, _, _ in pieces[1:]] == [j for _, j, _, _ in pieces[:-1]] and pieces[-1][1] == len(texts)
    assert all(8 * len(buf) <= 1 << 21 or j == i + 1 for i, j, buf, _ in pieces)
    whole = [decontam.text_words(buf, offs)[1] for _, _, buf, offs in nt.slices(column, 1 << 30)]
    parts = [decontam.text_words(buf, offs)[1] for _, _, buf, offs in pieces]
    assert (np.concatenate(whole) == np.concatenate(parts)).all()
