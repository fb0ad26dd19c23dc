"""Conversation repair, token counts, collocations: against brute force, the library and SQL."""
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import collocate, convrepair, tokencount
from quarry.llm.queries import tokenizer_path
from tests.llm.helpers import LONG, documents, same

# -- conversation repair -----------------------------------------------------

SENTENCE = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) over all scripts of (initial, fault) rows."""
    best, todo = (3 * len(rows), "D" * len(rows)), [(0, 0, "", "")]
    while todo:
        i, cost, audit, signs = todo.pop()
        if cost > best[0]:
            continue
        if i == len(rows) and SENTENCE.fullmatch(signs):
            best = min(best, (cost, audit))
        todo += [(i, cost + 2, audit + "I", signs + s) for s in "ua"]
        if i < len(rows):
            sign, fault = rows[i]
            todo.append((i + 1, cost + 3, audit + "D", signs))
            if fault < 2:
                todo.append((i + 1, cost + fault, audit + "K", signs + (sign or "#")))
                todo += [(i + 1, cost + 2 + fault, audit + "R", signs + s) for s in "ua"]
    return best


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row, row] if kind == 3 else [row]
    return out


def expected(original, rows):
    """The query's row of each conversation, plainly."""
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64]))
        seen, faults = set(), []
        for _, role, text in mine:
            end = text.rstrip(SPACE)
            faults.append(3 if not end else 2 if (role, text) in seen else 0 if end[-1] in ".!?" else 1)
            seen.add((role, text))
        signs = [r[1][:1] for r in mine]
        turns = {r[0] for r in mine if r[0] is not None}
        cost, audit = cheapest(list(zip(signs, faults)))
        lines, k = [], 0
        for e in audit:
            if e in "KRD":
                role, text = mine[k][1:]
                k += 1
            if e == "K":
                lines.append((role, text))
            elif e in "RI":
                lines.append(("?", text if e == "R" else ""))
        system = bool(lines) and lines[0][0][:1] == "s"
        lines = [((("user", "assistant")[(n - system) % 2]) if role == "?" else role) + ":" + text for n, (role, text) in enumerate(lines)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(3), faults.count(2), faults.count(1),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(signs, signs[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def chats(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rnd.randint(0, 5)):
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 3]), rnd.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]),
                         rnd.choice(["Yes.", "No", "One. Two!  ", "", " \n", None, "Same.", "Same.", "Really?\n"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    """With clashing column names."""
    return spark.createDataFrame([(*r, "x", 1, b"d", 2) for r in rows], SCHEMA + ", TEXT string, part int, digest binary, pos int")


def report(got):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got.collect()}


def test_least_edits_and_tables():
    rnd, r = random.Random(5), convrepair.Repair()
    for _ in range(250):
        rows = [(rnd.choice(["s", "u", "a", "u", "a", "x", ""]), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 5))]
        start, front = r.through(rows)
        cost, audit = r.best(front)
        assert (cost, start + audit) == cheapest(rows)
        k = rnd.randint(0, len(rows))
        front = {0: (0, "")}
        for part in filter(None, (rows[:k], rows[k:])):
            table = {}
            for node in range(len(r.nodes)):
                s, f = r.through(part, node)
                table[node] = {t: (c, s + a) for t, (c, a) in f.items()}
            front = r.joined(front, table)
        if rows:
            assert r.best(front) == cheapest(rows)


@pytest.mark.parametrize("held", [2048, 1])
def test_repair_equals_brute_force(spark, monkeypatch, held):
    """Also with nearly all conversations cut into parts and pieces."""
    monkeypatch.setattr(convrepair, "HELD", held)
    monkeypatch.setattr(convrepair, "PIECE", 2)
    rows = chats(held)
    d = frame(spark, rows)
    got = report(convrepair.repair_report(d, convrepair.damaged(d)))
    assert got == expected(rows, harm(rows))


def test_one_long_conversation(spark, monkeypatch):
    """One conversation holds most rows: it crosses partitions, its repeats too, and no task finishes it."""
    rnd = random.Random(9)
    rows = [(7, t, rnd.choice(["user", "assistant"]), rnd.choice([f"Text {t}.", f"Text {t % 50}.", "", f"cut {t}"])) for t in range(6000)]
    rows += [(k, t, r, "Fine.") for k in (1, 9) for t, r in enumerate(["user", "assistant"])]
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    verdicts, pieces = convrepair.repair(d)
    assert pieces.filter("conv_id = 7").select("part").distinct().count() > 1
    assert pieces.filter("conv_id = 7").selectExpr("max(size(turns))").first()[0] <= 2 * convrepair.PIECE
    got = report(convrepair.repair_report(d, d))[7]
    mine = [r for r in rows if r[0] == 7]
    seen, faults = set(), []
    for _, _, role, text in mine:
        faults.append(3 if not text else 2 if (role, text) in seen else 0 if text[-1] == "." else 1)
        seen.add((role, text))
    r = convrepair.Repair()
    start, front = r.through([(m[2][0], f) for m, f in zip(mine, faults)])
    cost, audit = r.best(front)
    lines = "\n".join(f"{role}:{text}" for role, text, _ in convrepair.edited(start + audit, [m[2:] for m in mine]))
    assert got[1:4] == (faults.count(3), faults.count(2), faults.count(1)) and got[0] == 0
    assert got[5:] == (cost, start + audit, hashlib.sha256(lines.encode()).hexdigest())


def test_repair_of_nothing(spark):
    d = frame(spark, [])
    assert convrepair.repair_report(d, convrepair.damaged(d)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    d = frame(spark, [(gone, 0, "user", "Gone.")])
    assert report(convrepair.repair_report(d, convrepair.damaged(d))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# -- token counts --------------------------------------------------------------

VOCABULARY = tokenizer_path("byte_bpe_50k.json")
ODD = ["<|endoftext|>", "a <|endoftext|>b", "it's IT'S we'll", "  two  spaces \n\n end ", "x\x1cy \x1f z\u0085w v", "1²Ⅷ٣", "日本語 😀 ßé", "ࢗᲉ new letters", "́combining",
       "a" * 5000, "ab " * 100_000, " " * 3000, "\r\n\t"]


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


def test_counts_equal_the_library(spark):
    docs = documents(spark, [*[(k, t) for k, t in enumerate(ODD)], (100, None), (101, ""), (None, "a row without an id"), (102, LONG), (102, LONG)])
    got = tokencount.count_tokens(docs, VOCABULARY).collect()
    assert len(got) == len(ODD) + 5
    plain = library()
    texts = dict(enumerate(ODD)) | {100: "", 101: "", None: "a row without an id", 102: LONG}
    for r in got:
        text = texts[r.doc_id]
        n = len(plain.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512), text[:40]
    assert tokencount.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_whole_tokens_are_one_token():
    with open(VOCABULARY, encoding="utf-8") as f:
        source = f.read()
    whole = tokencount.whole_tokens(source)
    plain, count = library(), tokencount.TokenCounter(source, whole)
    assert 45_000 < len(whole) <= 50_257
    for s in random.Random(1).sample(whole, 2000):
        if len(count.cut.findall(s)) == 1 and "<|" not in s:
            assert len(plain.encode(s, add_special_tokens=False).ids) == 1
    rnd = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'S", "'ll", "1", "é", "ß", "中", " ", "\u0085", "\x1c", "!", "...", "🙂", "<|endoftext|>", "²", "　"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert count(text)[0] == len(plain.encode(text, add_special_tokens=False).ids), text
    assert count("the cat")[1:] == (2, 0)


def test_pieces_of_long_texts_and_full_memory(monkeypatch):
    monkeypatch.setattr(tokencount, "SHORT", 10)
    monkeypatch.setattr(tokencount, "PIECES", 3)
    monkeypatch.setattr(tokencount, "CACHE", 2)
    monkeypatch.setattr(tokencount, "CACHE_CHARS", 4)
    with open(VOCABULARY, encoding="utf-8") as f:
        source = f.read()
    count, plain = tokencount.TokenCounter(source, tokencount.whole_tokens(source)), library()
    for text in (LONG[:3000], "zzxqy zzxqw zzxqy " * 50, "né é nnnzzzqq " * 20):
        n, direct, merged = count(text)
        assert n == len(plain.encode(text, add_special_tokens=False).ids) and direct + merged == len(count.cut.findall(text))


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        tokencount.count_tokens(documents(spark), tokenizer_path("word_bpe_49k.json"))


# -- collocations ----------------------------------------------------------------

VOCAB = ["the", "of", "and", "Red", "RED", "wine", "glass", "é", "日本", "x-y", "New", "York", "City"]


def passages(seed, n=200):
    rnd = random.Random(seed)
    fixed = "In New York City the red wine of the house; the red wine glass"
    out = []
    for k in range(n):
        text = "".join(rnd.choice(VOCAB) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]) for _ in range(rnd.randint(0, 40)))
        out.append((rnd.choice(["en", "de", None, "und"]), text + (fixed if k % 3 else "") if k % 17 else None))
    return out + [("en", ""), ("de", " \t.;\n"), ("en", "lonely"), ("en", "again " * 3000), ("fr", "again " * 40)]


def counted(rows):
    total, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                counts.update((lang, " ".join(w[i:i + n])) for i in range(len(w) - n + 1))
    return counts, total


def ranked(rows, least, top):
    counts, total = counted(rows)
    found = {k: a for k, a in counts.items() if " " in k[1] and a >= least}
    out = []
    for (lang, phrase), a in found.items():
        w = phrase.split(" ")
        covered = any(100 * f >= 80 * a and l2 == lang and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} " for (l2, q), f in found.items())
        if covered:
            continue
        score, _, left, right = min((2_000_000 * a // (counts[lang, " ".join(w[:k])] + counts[lang, " ".join(w[k:])]), k,
                                     counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])]) for k in range(1, len(w)))
        out.append((lang, -score, -a, phrase.encode(), (phrase, a, left, right, total[lang], score)))
    got, at = [], Counter()
    for lang, _, _, _, row in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            got.append((lang, at[lang], *row))
    return got


@pytest.mark.parametrize("every, most, bits", [(32, 512, 1 << 26), (3, 5, 64)])
def test_collocations_equal_brute_force(spark, every, most, bits):
    """Any parse and any filter, also a full one, gives the same counts."""
    rows = passages(4)
    d = spark.createDataFrame([(l, t, "x", 1, 2) for l, t in rows], "lang string, text string, TEXT string, freq int, chunk int")
    got = collocate.collocations(d, least=12, top=15, every=every, most=most, filter_bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == sorted(ranked(rows, 12, 15))
    counts, total = counted(rows)
    frequent, n = collocate.phrase_counts(d, 12, every, most, bits)
    assert {(r.lang, r.phrase): r.a for r in frequent.collect()} == {k: a for k, a in counts.items() if a >= 12}
    assert {r.lang: r.n for r in n.collect()} == {k: v for k, v in total.items() if v}


def test_collocations_equal_sql_and_nothing(spark):
    rows = passages(6, 400)
    d = spark.createDataFrame(rows, "lang string, text string")
    same(collocate.collocations(d), collocate.oracle_sql(), {"documents": d})
    assert collocate.collocations(d.limit(0)).count() == 0
    assert collocate.collocations(d.filter("text IS NULL")).count() == 0


def test_copies_share_chunks(spark):
    d = spark.createDataFrame([("en", LONG)] * 20, "lang string, text string")
    words = collocate.dictionary(d)
    assert words.filter("freq <> 20").count() == 0
    assert words.selectExpr("sum(words * freq)").first()[0] == 20 * len(LONG.split())
