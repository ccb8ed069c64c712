from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartoquill.llm import tokenfile, tokens, transducer

BPE, WORDS, PIECES = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "\n", "a\n b", "a \nb", "it's so", "x<|endoftext|> y", "<|endoftext|>", "é ü", "中文 字", "\x1c a\x1cb", "\xa0x 　y", "A,b. C!! d%%%", "don't, 'tis", "1st 2nd", "the " * 3000, "x" * 5000, "\x00 \x00a", "a\tb", "a \t b", "▁a ▁", "    indent", "<s> </s> <unk> <0x41>", "😀 ok"]
pieces = st.lists(st.sampled_from([" ", "  ", "\n", "a", "the", "Er", "'s", ",", "!!", "1", "é", "中", "\x1c", "\xa0", "<|endoftext|>", "\t", "▁", "==", "😀"]), max_size=14).map("".join)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "again", "x"), (99, None, "x")], "doc_id long, text string, n_tokens string")


def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BPE, WORDS])
def test_counts_of_odd_texts(odd, path):
    t = library(path)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(odd, path).collect())
    rows = [(i, x) for i, x in enumerate(ODD)] + [(-1, "no id"), (3, "again"), (99, "")]
    want = sorted((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for i, x in rows)
    assert got == want


def test_counts_of_sentencepiece(odd):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(odd.where("doc_id <> 3"), PIECES).collect()}
    assert all(got[i] == len(m.encode(x)) for i, x in enumerate(ODD) if i != 3)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_segments_encode_as_the_whole(text):
    n = len(library_once().encode(text, add_special_tokens=False).ids)
    assert tokens._lengths(BPE, [text]) == [n]
    assert [sum(x) for x in tokens.memo(BPE, "n", len).sums([text])] == [n]


@settings(max_examples=300, deadline=None)
@given(pieces.map(lambda t: t * 5))
def test_cuts_are_safe(text):
    long, tokens.LONG = tokens.LONG, 7
    try:
        m = tokens.memo(BPE, "n", len)
        assert "".join(m.chunks(text)) == text
        assert m.encode([text]) == [len(library_once().encode(text, add_special_tokens=False).ids)]
    finally:
        tokens.LONG = long


_once = []


def library_once():
    if not _once:
        _once.append(library(BPE))
    return _once[0]


def test_cache_bounds_and_slices(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 20)
    monkeypatch.setattr(tokens, "SLICE", 7)
    m = tokens.Memo(BPE, len)
    texts = [" ".join(f"w{k % 37}x{j}," for k in range(j * 9)) for j in range(12)] + ["y" * 500 + " z"]
    for _ in range(3):
        assert [sum(x) for x in m.sums(texts)] == [len(library_once().encode(t, add_special_tokens=False).ids) for t in texts]
    assert "y" * 500 not in m.new


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_counts(none, BPE).count() == 0
    assert transducer.encode_pieces(none, PIECES).count() == 0
    assert tokenfile.token_file(none, BPE).count() == 0


# ---- op 7


def test_token_file_round_trip(spark, odd, tmp_path):
    t = library(BPE)
    got = [tuple(r) for r in tokenfile.token_file(odd, BPE, folder=str(tmp_path / "f")).collect()]
    rows = sorted([(-1, "no id"), *enumerate(ODD), (3, "again"), (99, "")], key=lambda r: (r[0], r[1]))
    at, want = 0, []
    for i, x in rows:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        want.append((None if i < 0 else i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_short_document_access_and_dictionary(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = tokenfile.train_dictionary(docs, BPE)
    assert data == tokenfile.train_dictionary(docs, BPE)
    shards = tokenfile.write_tokens(docs, str(tmp_path), BPE, dictionary=data)
    assert sum(s[3] for s in shards) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for p in tmp_path.glob("shard-*.cqt"):
        s = tokenfile.Shard(p.read_bytes(), data)
        k = len(s.doc_ids) // 2
        assert s.ids(k).tolist() == [*library_once().encode(texts[int(s.doc_ids[k])], add_special_tokens=False).ids, 2]
        with pytest.raises(ValueError):
            tokenfile.Shard(p.read_bytes(), data + b"x")
        with pytest.raises(ValueError):
            tokenfile.Shard(p.read_bytes()[:-1], data)
    one = sorted(tmp_path.glob("shard-*.cqt"))[0]
    kind, part, _, number = one.name.split("-")
    (tmp_path / f"{kind}-{part}-999999-{number}").write_bytes(one.read_bytes())  # left by an attempt that was lost
    assert tokenfile.read_tokens(spark, str(tmp_path), shards, data).count() == docs.count()
    ids = tokenfile.read_tokens(spark, str(tmp_path), shards, data, with_ids=True).where("doc_id = 5").first()["ids"]
    assert library_once().decode(ids[:-1]) == texts[5]


@pytest.mark.parametrize("texts", [["a"], ["", ""], ["one word more"] * 3, ["the same text again " * 40] * 200])
def test_small_tables_have_a_dictionary_too(spark, tmp_path, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = tokenfile.train_dictionary(docs, BPE)
    assert len(data) >= 8
    back = tokenfile.read_tokens(spark, str(tmp_path / "x"), tokenfile.write_tokens(docs, str(tmp_path / "x"), BPE, dictionary=data), data, with_ids=True)
    assert {r["doc_id"]: library_once().decode(r["ids"][:-1]) for r in back.collect()} == dict(enumerate(texts))


def test_shards_are_bounded(monkeypatch, tmp_path):
    """A task's documents go on in a new shard when one is full."""
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 400)
    r = np.random.default_rng(0)
    done = list(tokenfile.shards_of(((k, r.integers(0, 50_000, 300).astype("<u2")) for k in range(9)), str(tmp_path), (3, 5), b"x" * 8, 2))
    assert len(done) == 9 and [d[:4] for d in done] == [(3, 5, k, 1) for k in range(9)]
    assert len(list(tmp_path.glob("shard-000003-5-*.cqt"))) == 9


def test_query_against_the_library(spark):
    from cartoquill.llm import catalogue

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in catalogue.op7_token_file(spark, "/root/testdata/sf0.001").collect():
        ids = np.array([*library_once().encode(docs[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    for r in catalogue.op1_token_counts(spark, "/root/testdata/sf0.001").collect():
        assert r["n_tokens"] == len(library_once().encode(docs[r["doc_id"]], add_special_tokens=False).ids)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in catalogue.op2_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        assert r["ids"] == m.encode(docs[r["doc_id"]])


def test_query_starts_follow_each_other(spark):
    from cartoquill.llm import catalogue

    rows = catalogue.op7_token_file(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def ids_of(text):
    return library_once().encode(text, add_special_tokens=False).ids


def test_new_words_are_merged_in_groups(monkeypatch):
    """Each new word went to the library by itself, and each word of a text through Python, which took more than op7's time."""
    calls, one = [], tokens.Memo.one
    monkeypatch.setattr(tokens.Memo, "one", lambda self, w: calls.append(w) or one(self, w))
    tokens._made.clear()
    letters = [a + b + c for a in "aBéàß" for b in "stuvwxyz" for c in "klmnoà"]
    texts = [" ".join(letters), "\n".join(letters[:9]), " ".join(w + "." for w in letters)]
    assert [x.tolist() for x in tokenfile.encode(BPE, texts, "<u2")] == [ids_of(t) for t in texts]
    assert len(calls) < len(letters) / 2


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_packed_odd_texts(monkeypatch, part):
    monkeypatch.setattr(tokenfile, "PART", part)
    more = ["a\n", "\na", "\n\na", "a\n\nb", "a\n\n\nb", "a\n b", "a \n b", "a\r\nb", "a\n\n b.\nC", " \n", "a\u2028b c", "à à\xa0 à", "voilà tout à la", "a\n<|endoftext|>\nb <|endoftext|> c", "z" * 300 + " z. " + "z" * 300 + ".", "it's\n'tis 's", "¹ ² ª º", "ǅ ʰ ɐ", "\n" * 9, "a" + " " * 9 + "b", "  ", "..", "é\u0301 e\u0301"]
    m = tokenfile.Packed(BPE, "<u2")
    for texts in (ODD + more, more[::-1], [], [""], [t + s for t in ODD + more for s in ("", " x", "\ny", "\n")]):
        assert [np.frombuffer(x, "<u2").tolist() for x in m.pack(texts)] == [ids_of(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", " ", "\n", "\n", "a", "the", "à", "Er", "'s", ",", ".", "!!", "1", "中", "\x1c", "\xa0", "\x85", "<|endoftext|>", "\t", "_", "ß"]), max_size=14).map("".join), max_size=6))
def test_packed_as_the_library(texts):
    assert [x.tolist() for x in tokenfile.encode(BPE, texts, "<u2")] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("white", ["\t", "\r", "\x0b", "\xa0", "\u3000"])
def test_what_sums_learns_is_not_taken_for_a_packed_word(white):
    m = tokenfile.Packed(BPE, "<u2")
    for texts in ([f"a{white} b", f"a{white}c d"], [f"x a{white}\n"], [f"x a{white}\n\nb"], [f"x a{white}c\nd"]):
        assert [np.frombuffer(x, "<u2").tolist() for x in m.pack(texts)] == [ids_of(t) for t in texts]
    m.values([])
    assert not any(white in w for w in [*m.new, *m.old])


def test_packed_other_models():
    t = library(WORDS)
    assert [x.tolist() for x in tokenfile.encode(WORDS, ODD, "<u4")] == [t.encode(x, add_special_tokens=False).ids for x in ODD]


def test_packed_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    m = tokenfile.Packed(BPE, "<u4")
    for j in range(6):
        texts = [" ".join(f"{a}{b}{c}{t}" for a in "abc" for b in "xyz" for t in ("", ".", "1"))[j * k :] for k in range(5) for c in "qr"] + ["y" * 500 + " z " + "y" * 500 + "."]
        assert [np.frombuffer(x, "<u4").tolist() for x in m.pack(texts)] == [ids_of(t) for t in texts]
    m.values([])
    assert not any(len(w) > 200 for w in [*m.new, *m.old])


# ---- op 2


@pytest.fixture(scope="module")
def machine():
    import sentencepiece

    return transducer.transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("text", ODD)
def test_pieces_of_odd_texts(machine, text):
    t, m = machine
    assert t.encode(text).tolist() == m.encode(text)
    assert t.decode(m.encode(text)) == m.decode(m.encode(text))


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_pieces_against_the_library(machine, text):
    t, m = machine
    assert t.encode(text).tolist() == m.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_any_text(machine, text):
    t, m = machine
    ids = t.encode(text).tolist()
    assert ids == m.encode(text)
    if "▁" not in text:
        assert t.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(pieces)
def test_both_searches_find_the_same_path(machine, text):
    t, _ = machine
    run = t.normaliser.run(text)
    assert not run or t.furthest(run) == t.settled(run)


def test_broken_bytes_decode_like_the_library(machine):
    t, m = machine
    for ids in ([t.byte[0xE4]], [t.byte[0xE4], t.byte[0xB8], t.byte[0xAD]], [1, 2, t.piece["▁a"]]):
        assert t.decode(ids) == m.decode(ids)


def test_piece_query(odd):
    rows = {r["doc_id"]: r for r in transducer.encode_pieces(odd.where("doc_id <> 3"), PIECES).collect()}
    t = transducer.transducer(PIECES)
    for i, x in enumerate(ODD):
        if i != 3:
            ids = t.encode(x)
            assert rows[i]["ids"] == ids.tolist() and rows[i]["n_ids"] == len(ids) and rows[i]["ids_crc32"] == zlib.crc32(ids.tobytes())
            assert rows[i]["round_trip"] == ("▁" not in x) and rows[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids.tolist()).encode()).hexdigest()
    assert rows[99]["n_ids"] == 0


def proto(n, v):
    def varint(x):
        return bytes([x]) if x < 128 else bytes([x & 127 | 128]) + varint(x >> 7)

    if isinstance(v, int):
        return varint(n << 3) + varint(v)
    return varint(n << 3 | 5) + np.float32(v).tobytes() if isinstance(v, float) else varint(n << 3 | 2) + varint(len(v)) + v


@pytest.mark.parametrize("seed", range(12))
def test_models_of_both_kinds_against_the_library(tmp_path, seed):
    """Unigram and BPE models with and without byte fallback, rules, a dummy prefix, squeezing; the pieces are made up, not trained."""
    import random

    import sentencepiece

    r = random.Random(seed)
    kind, fallback, squeeze, dummy = 1 + seed % 2, seed // 2 % 2, r.choice([0, 1]), r.choice([0, 1])
    rules = dict(transducer._fields(dict(transducer._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]))[2]
    words = {"▁": -2.0} | {c: -r.random() * 5 - 3 for c in "abcdeABüéf"}
    for _ in range(60):
        words.setdefault(r.choice(["", "▁"]) + "".join(r.choice("abcde") for _ in range(r.randrange(1, 5))), -r.random() * 9 - 1)
    if kind == 2:
        words = {w: -float(i) for i, w in enumerate(words)}
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256 * fallback)), *((w, s, 1) for w, s in words.items())]
    if kind == 1 and "cde" not in words:
        made.append(("cde", 0.0, 4))
    body = b"".join(proto(1, proto(1, t.encode()) + proto(2, s) + proto(3, k)) for t, s, k in made)
    spec = proto(1, b"x") + (proto(2, rules) if seed % 3 else b"") + proto(3, dummy) + proto(4, squeeze) + proto(5, 1)
    (tmp_path / "m.model").write_bytes(body + proto(2, proto(3, kind) + proto(35, fallback)) + proto(3, spec))
    m, t = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), transducer.Transducer(str(tmp_path / "m.model"))
    for _ in range(400):
        text = "".join(r.choice("abcdeab  cdeABf ｆﬁ①Å　\tüéz😀▁") for _ in range(r.randrange(0, 25)))
        assert t.encode(text).tolist() == m.encode(text)
        assert t.decode(m.encode(text)) == m.decode(m.encode(text))


def test_long_texts_without_spaces(machine):
    t, m = machine
    for text in ("\n".join(["word"] * 30_000), "中文字" * 40_000, "ab" * 100_000):
        assert t.encode(text).tolist() == m.encode(text)
        assert tokens._lengths(BPE, [text]) == [len(library_once().encode(text, add_special_tokens=False).ids)]
        assert len(tokens.memo(BPE, "n", len).chunks(text)) > 10 or "ab" in text


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m.model").write_bytes(b"")
    with pytest.raises(ValueError):
        transducer.Transducer(str(tmp_path / "m.model"))


def test_words_around_a_lines_end_take_no_room():
    """Each such pair took a place of its own, so that the words of a corpus did not fit and were merged again and again."""
    m = tokens.Memo(BPE, list)
    text = "first " + " ".join(f"{w}{t}" for w in ("alpha", "beta", "été") for t in ("", ".", ",", "!?", ".\nalpha"))
    assert sum(m.sums([text])[0], []) == library_once().encode(text, add_special_tokens=False).ids
    m.learn(set())
    kept = set(m.new) | set(m.old)
    assert "\nalpha" in kept and {"alpha", "beta.", "été!?"} <= kept and not any("\n" in w[1:] for w in kept)


@pytest.mark.parametrize("content", [b"", proto(2, proto(3, 2)), proto(3, proto(3, 1))])
def test_models_without_pieces_are_refused(tmp_path, content):
    (tmp_path / "m.model").write_bytes(content)
    with pytest.raises(ValueError, match="no pieces"):
        transducer.Transducer(str(tmp_path / "m.model"))
