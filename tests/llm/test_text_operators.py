"""Tokenizer operators, chat formatting and substring de-duplication against brute force, with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qaforge.llm import chat, packing, pieces, substring_dedup, token_counts, token_store

VOCAB, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "a  b", "\n\n a", " a\n \n b ", "x<|endoftext|> y", "<s> a </s>", "▁a▁▁b", "é ñ 𝔘 🎉", "\x1c \x1c\x1d", "I'll don't", "tab\tand\r\nline", "word " * 3000, "z" * 5000]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    letters = [" ", " ", "\n", "a", "the", "'s", "1", "!", "é", "▁", "\x1c", "<|endoftext|>", "\t", "x", "　", "ing"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_the_library():
    texts = [t for t in ODD if t is not None] + random_texts(5000)
    encoder = pieces.PieceEncoder(VOCAB, keep=500)  # a small memo starts anew again and again
    texts += ["Word, word. Word\n\nNew (word); it's a1b2 l'été... " + w for w in ("x", "<|endoftext|>,", "na\u00efve!", "\u0939\u093f\u0928,", "a\u00a0b", "\u3000")]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    for end in (None, 7):
        got = []
        for g in pieces.in_groups(texts, 2000):
            ids, count = encoder.encode(pa.array(g), end)
            got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == [ids + [7] * (end is not None) for ids in want]
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0] and encoder.encode(pa.array([""]), 7)[0].tolist() == [7]


def test_counter_equals_the_library():
    texts = [t for t in ODD if t is not None] + random_texts(5000, 2)
    counter = pieces.PieceCounter(MODEL, keep=33_000)
    got = [n for g in pieces.in_groups(texts, 2000) for n in counter.count(g)]
    assert got == [len(x) for x in counter.library.encode(texts)]
    assert len(counter.alone) > 10_000


def documents(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"score": F.lit("own"), "n_tokens": F.lit("own"), "removed": F.lit("own"), "length": F.lit("own"), "ids": F.lit(1), "role": F.lit(0)}) if extra else df


def test_token_counts(spark):
    df = documents(spark, ODD, extra=True)
    rows = {r["doc_id"]: r for r in token_counts.token_counts(df.unionByName(df), MODEL, limit=2000).collect()}
    sp = pieces.PieceCounter(MODEL).library
    for i, t in enumerate(ODD):
        n = len(sp.encode(t or ""))
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 2000)
    assert token_counts.token_counts(df.limit(0), MODEL).count() == 0
    assert token_counts.with_token_counts(df, MODEL).where("score = 'own'").count() == len(ODD)


def test_index_is_minimal_and_perfect():
    ids = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    h = token_store.key_hash(ids, np.zeros(len(ids), np.int64))
    index = token_store.Index(token_store.build_index(h, np.arange(len(h)) % 7, np.arange(len(h)), np.arange(len(h))))
    at = index.find(h)
    assert sorted(at) == list(range(len(h))) and (index.records["offset"][at] == np.arange(len(h))).all()
    assert (index.find(token_store.key_hash(ids + 1, np.zeros(len(ids), np.int64))) >= 0).sum() == 0
    assert len(token_store.Index(token_store.build_index(h[:0], h[:0], h[:0], h[:0])).find(h[:3])) == 3


def test_store_round_trip(spark, tmp_path):
    rows = [(i * 7 % 40, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (-5, "minus")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    store = token_store.write_store(df, f"file://{tmp_path}/store", VOCAB, end_id=0, keys_per_bucket=5)
    keys = [(i, 0) for i in sorted({i for i, _ in rows if i is not None})] + [(3, k) for k in range(1, sum(i == 3 for i, _ in rows))] + [(0, 1 << 62), (999, 0)]
    found = token_store.lookup(spark.createDataFrame(keys, "doc_id long, occurrence long"), store)
    got = {(r["doc_id"], r["occurrence"]): (r["start"], r["ids"]) for r in token_store.read_ids(found, store).collect()}
    encode = lambda t: [*library().encode(t or "", add_special_tokens=False).ids, 0]
    start, want, times = 0, {}, {}
    hashes = dict(tuple(r) for r in df.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""])):
        k = times[i] = times.get(i, -1) + 1
        want[(0, 1 << 62) if i is None else (i, k)] = (start, encode(t))
        start += len(encode(t))
    assert got == want
    empty = token_store.write_store(df.limit(0), f"file://{tmp_path}/empty", VOCAB)
    assert token_store.lookup(spark.createDataFrame(keys, "doc_id long, occurrence long"), empty).count() == 0


def test_store_of_one_hot_id(spark, tmp_path):
    """Copies under one id, and rows without an id, are dealt over tasks; their occurrences are counted on."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(7, "copy of one text")] * 300 + [(7, f"text {i}") for i in range(100)] + [(None, f"no id {i}") for i in range(200)] + [(i, "") for i in range(20)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        store = token_store.write_store(df, f"file://{tmp_path}/hot", VOCAB, end_id=0, keys_per_bucket=100)
        assert store["shards"].count() == 4
        keys = token_store.keys_of(df)
        assert sorted(tuple(r) for r in keys.collect()) == sorted([(7, k) for k in range(401)] + [(0, (1 << 62) + k) for k in range(200)] + [(i, 0) for i in range(20) if i != 7])
        read = token_store.read_ids(token_store.lookup(keys, store), store).collect()
        assert len(read) == len(rows) == len({(r["doc_id"], r["occurrence"]) for r in read})
        at = 0
        for r in sorted(read, key=lambda r: r["start"]):
            assert r["start"] == at
            at += len(r["ids"])
        encode = lambda t: [*library().encode(t, add_special_tokens=False).ids, 0]
        ids = lambda r: None if r["occurrence"] >= 1 << 62 else r["doc_id"]
        assert sorted(((ids(r), r["ids"]) for r in read), key=repr) == sorted(((i, encode(t)) for i, t in rows), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lower_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 101, 300)
        bins, offsets, left = packing.best_fit_decreasing(lengths, 100)
        assert (np.bincount(bins, lengths) + left == 100).all() and (left >= 0).all()
        assert packing.lower_bound(np.bincount(lengths, minlength=101)) <= len(left)
    # Halves and a bit: no two fit together, which the plain sum does not see.
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101)) == 10
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101)) == 5


def test_packing(spark):
    texts = [*ODD, *("word " * n for n in range(0, 2500, 61))]
    df = documents(spark, texts, extra=True)
    rows = packing.pack_documents(df.unionByName(df.where("doc_id = 4")), VOCAB).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc.pop(4)) == 2
    for i, t in enumerate(texts):
        if i == 4:
            continue
        ids = np.array([*library().encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:]) and (len(own) == 1 or len(own) == -(-len(ids) // 1024))
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1]] and ends[-1] <= 1024
    histogram = np.bincount([r["length"] for r in rows], minlength=1025)
    assert packing.lower_bound(histogram) <= len(by_sequence) <= packing.lower_bound(histogram) + 2
    assert packing.pack_documents(df.limit(0), VOCAB).count() == 0
    packed = spark.createDataFrame([(r["length"], r["offset"]) for r in rows], "length long, offset long")
    assert packing.certificate(packed) == (len(by_sequence), packing.lower_bound(histogram)) and packing.certificate(packed.limit(0)) == (0, 0)


def test_partitions_exchange(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(200, 700, 900)
    df = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(lengths)], "uid long, length long")
    rows = packing.pack(df, 1024, per_partition=100).collect()
    assert sorted((r["uid"], r["length"]) for r in rows) == sorted((i, int(n)) for i, n in enumerate(lengths))
    n = len({r["sequence_id"] for r in rows})
    alone = sum(len(packing.best_fit_decreasing(part, 1024)[2]) for part in np.array_split(lengths, 9))
    assert packing.lower_bound(np.bincount(lengths, minlength=1025)) <= n <= alone


def test_chat_round_trip(spark):
    marks = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[:]", "[/ROLE]", "[+]", "[", "<", "\\", "[\\INST]", "<\\\\s>", "x", "\n", "$1", "é🎉"]
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "[:]", None]), rng.choice([None, "", "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))])))
    rows += [(100, None, "user", "first"), (100, 1, "assistant", "same"), (100, 1, "assistant", "same"), (None, 0, "user", "no id"), (101, 0, "user", "a long one"), (101, 1, "assistant", "[INST] x </s> " * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("own"))
    formatted = chat.format_conversations(df)
    read = {r["conv_id"]: r for r in chat.parse(formatted).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {k: [tuple(t) for t in r["turns"]] for k, r in read.items()} == want
    assert {k: r["loss"] for k, r in read.items()} == {k: "".join(t for role, t in v if role == "assistant") for k, v in want.items()}
    assert chat.format_conversations(df.limit(0)).count() == 0
    plan = chat.digest(formatted)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_adjacent_turns_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "tool", "d")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df).first()
    assert r["formatted"] == "[INST]a[+]b[/INST]<s>c</s>[ROLE]tool[:]d[/ROLE]"
    assert [tuple(s) for s in r["loss_spans"]] == [(21, 22)]


def test_long_conversation(spark):
    """Offsets, the loss text and the turns of a long conversation, whose first letters look like byte order marks."""
    n = 6000
    text = lambda i: f"\ufeffé🎉 {i} [INST] words </s>" if i % 7 else ""
    rows = [(1, i, "assistant" if i % 3 else "user", text(i)) for i in range(n)] + [(2, 0, "user", "no answer")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted = {r["conv_id"]: (r["formatted"], [tuple(x) for x in r["loss_spans"]]) for r in out.collect()}
    assert formatted[2][1] == [] and len(formatted[1][1]) == n - n // 3
    whole, spans = formatted[1]
    escaped = lambda t: re.sub(r"([\[<])(\\*)((?:/?(?:SYS|INST|ROLE)|\+|:)\]|/?s>)", r"\1\\\2\3", t)
    assert [whole[a:b] for a, b in spans] == [escaped(text(i)) for i in range(n) if i % 3]
    r = chat.digest(out).where("conv_id = 1").first()
    loss = "".join(text(i) for i in range(n) if i % 3)
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    odd = spark.createDataFrame([(None, "", [], 1), (3, None, None, 2)], "conv_id long, formatted string, loss_spans array<struct<begin:long,end:long>>, turns int")
    assert [(r["conv_id"], r["n_turns"], r["formatted_chars"]) for r in chat.digest(odd).orderBy("conv_id").collect()] == [(None, 0, 0), (3, None, None)]


LONG = "one two three four five six seven eight nine ten eleven"


def test_repeated_lines(spark):
    rows = [
        (5, f"{LONG}\nunlike anything else\n{LONG.upper()}", 1),
        (1, f"short line\n  One two\tthree four five six seven eight nine ten eleven  \nshort line", 1),
        (9, f"a\n{LONG}", 1),
        (9, f"a\n{LONG}", 1),
        (7, LONG, 1),
        (8, None, 1),
        (6, "", 1),
        (2, " \n\t", 1),
        (None, f"x\n{LONG}", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed int").withColumn("n_chars", F.length("text").cast("long"))
    out = substring_dedup.without_repeats(df)
    got = sorted(((r["doc_id"], r["text"], r["n_chars"], [(s["start"], s["end"]) for s in r["removed"]]) for r in out.collect()), key=repr)
    n = len(LONG)
    want = [(5, "unlike anything else\n", [(0, n + 1), (n + 22, 2 * n + 22)]), (1, "short line\n  short line", [(13, 13 + n + 3)]), (9, "a\n", [(2, n + 2)]), (9, "a\n", [(2, n + 2)]), (7, "", [(0, n)]), (8, None, []), (6, "", []), (2, " \n\t", []), (None, f"x\n{LONG}", [])]
    assert got == sorted(((i, t, None if t is None else len(t), s) for i, t, s in want), key=repr)
    clashing = df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("_doc", "_HASH", "_places", "_rest", "__rest", "doc", "text_hash", "digest", "place", "again")})
    kept = substring_dedup.without_repeats(clashing, removed_col="gone")
    assert kept.columns == [*clashing.columns, "gone"]
    assert all(r["doc_id"] is None or r[c] == f"{c}{r['doc_id']}" for r in kept.collect() for c in ("_doc", "_HASH", "_places", "_rest", "__rest", "again"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(((x[0], x[1]) for x in want), key=repr)
    assert substring_dedup.repeats(df.limit(0)).count() == 0 and substring_dedup.without_repeats(df.limit(0)).count() == 0


def brute_force_rest(docs, least, chars, window, run):
    """Cleaned texts of docs (in order of rank, no id twice) by sets of word tuples."""
    low = lambda w: w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    key = lambda a, b: (7 * len(a) * a[0] + 31 * a[-1] + 13 * b[0] + len(b)) % 257
    first, out = {}, {}
    for i, text in docs:
        at = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", text)]
        w = [low(text[a:b]) for a, b in at]
        line = [text[:a].count("\n") for a, _ in at]
        found = []
        for k in sorted(set(line)):
            own = [p for p, x in enumerate(line) if x == k]
            if len(own) >= least or len(" ".join(w[p] for p in own)) >= chars:
                found.append(("line", own[0], own[-1] + 1))
        if window:
            keys = [key(w[p].encode(), w[p + 1].encode()) for p in range(len(w) - window + 1)]
            chosen = {min(range(p, p + 5), key=lambda q: (keys[q], q)) for p in range(len(keys) - 4)} if len(keys) >= 5 else range(len(keys))
            found += [("passage", p, p + window) for p in sorted(chosen)]
        gone, passed = [False] * len(w), [False] * (len(w) + 1)
        for what, a, b in found:
            doc, end = first.setdefault((what, tuple(w[a:b])), (i, b))
            if doc != i or a >= end:
                (gone if what == "line" else passed)[a:b] = [True] * (b - a)
        begun = None
        for p, x in enumerate(passed):
            if x and begun is None:
                begun = p
            elif not x and begun is not None:
                if p - begun >= run:
                    gone[begun:p] = [True] * (p - begun)
                begun = None
        kept, p = text[: at[0][0]] if at else text, 0
        while p < len(w):
            q = p
            while q < len(w) and gone[q] == gone[p]:
                q += 1
            stop = at[q][0] if q < len(w) else len(text)
            if not gone[p]:
                kept += text[at[p][0] : stop]
            elif p and line[p - 1] == line[p] and "\n" in text[at[q - 1][1] : stop]:
                kept += text[at[q - 1][1] : stop]
            p = q
        out[i] = kept
    return out


@pytest.mark.parametrize(("least", "chars", "window", "run"), [(1, 1000, 0, 0), (3, 9, 0, 5), (1000, 1000, 3, 0), (4, 12, 4, 4), (1000, 1000, 3, 5), (4, 12, 4, 6)])
def test_repeats_against_brute_force(spark, least, chars, window, run):
    rng = random.Random(least + window)
    parts = ["a b c", "A  b c", "d e", "f", "", " g h i j", "été 水水 x", "k l m n o p", "　q r"]
    docs = [(i, "".join(rng.choice(parts) + rng.choice(["\n", " ", "\n\n", " \t"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = substring_dedup.without_repeats(df, least, chars, window, least_run=run).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute_force_rest(docs, least, chars, window, run)
    texts = dict(docs)
    for r in out:
        gone = [(s["start"], s["end"]) for s in r["removed"]]
        cuts = [0, *(x for s in gone for x in s), None]
        assert gone == sorted(gone) and "".join(texts[r["doc_id"]][a:b] for a, b in zip(cuts[::2], cuts[1::2])) == r["text"]


def test_repeated_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(55) for _ in range(12)]
    docs, planted = [], []
    for i in range(120):
        body = prose(80).split(" ")
        if i % 3 == 0:
            at, p = rng.randrange(80), passages[i % 12]
            body[at:at] = [p if i % 2 else p.replace(" ", "\n", 3)]
            planted.append((i, p))
        docs.append((i, " ".join(body)))
    big = prose(60_000)
    docs += [(1000, big), (1001, "before " + big + " after"), (2000, "shared head"), (2000, passages[1] + " of the same id"), (2000, passages[1] + " of that id")]
    out = {}
    for r in substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    seen = set()
    for i, p in planted:
        left = len(set(p.split()) & set(out[i][0].split())) / len(set(p.split()))
        assert left == 1 if p not in seen else left <= 0.2
        seen.add(p)
    assert all(out[i] == [t] for i, t in docs if i < 1000 and i % 3)
    assert out[1000] == [big] and len(out[1001][0]) < 100 and out[1001][0].startswith("before ") and out[1001][0].endswith(" after")
    assert len(out[2000]) == 3 and sum(p.startswith(passages[1] + " of") for p in out[2000]) == 1 and sum(len(p) < 100 for p in out[2000]) == 2


def test_a_lone_phrase_stays(spark):
    """Twenty shared words are a phrase, fifty a passage; a long text too, and one whose passage is cut up by other words."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))
    phrase, passage = prose(20), prose(50)
    parts = passage.split(" ")
    cut = " ".join([*parts[:20], "other", *parts[20:40], "words", *parts[40:]])
    docs = [(1, f"{prose(30)} {phrase} {prose(30)} {passage}"), (2, f"{prose(40)} {phrase} {prose(40)}"), (3, f"{prose(20_000)} {passage} {prose(20_000)}"), (4, f"{prose(10)} {cut} {prose(10)}")]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == t for i, t in docs if i in (1, 2, 4))
    assert 40_000 <= len(out[3].split()) <= 40_008


def test_passages_of_short_lines_and_of_one_word(spark):
    verse = "\n".join(f"verse {i} of the song" for i in range(12))  # 60 words, five a line
    script = "水" * 70  # one word to the eye of white space
    rows = [(1, f"own start\n{verse}\nown end"), (2, f"other start\nmore\n{verse.upper()}\nother end"), (4, "\n".join(["la la"] * 100)), (5, f"x\n{script}"), (6, f"y\n{script}"), (6, f"y\n{script}"), (7, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    # Of (4), a unit's 16 words stay and, at its end, STEP - 1.
    assert {r for r in got if r[0] != 2} == {rows[0], (4, "\n".join(["la la"] * (8 + 2))), rows[3], (6, "y\n"), rows[6]} and len(got) == 7
    other = next(t for i, t in got if i == 2)
    assert other.startswith("other start\nmore\n") and other.endswith("other end") and len(other.split()) < 12
