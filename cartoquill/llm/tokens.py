"""Token counts (op 1): lengths of batch encodings, in Arrow functions."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: A cut before a single space is safe if something other than white space follows: the byte-level pattern joins such
#: a space to what follows it, its other white-space branches end before it, and no special token holds a space.
SAFE = re.compile(r" (?=\S)")
_OTHER = re.compile(r"[^\S \n]")
#: What _OTHER finds in ASCII.
_WHITE = "\t\r\v\f\x1c\x1d\x1e\x1f"
#: Punctuation that ends a word of letters parts from it before merging; apostrophes and what special tokens hold are left out.
TAIL = ".,!%&*#$?;:"
#: Letters below this are letters in every version of Unicode.
_LATIN = "\u0250"
CACHE, SLICE = 800_000, 800_000
_made: dict[object, object] = C.kept()


#: Segments beyond so many characters are cut further.
LONG = 4096
#: A cut before white space that follows something else is safe: no pre-token goes on over it, and what begins there is read alike.
_GAP = re.compile(r"(?<=\S)(?=\s)")
#: So is one where letters, digits and other signs change, but behind an apostrophe and at signs of special tokens.
_TURN = re.compile(r"(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])|(?<=[^\W\d_])(?=[.,;:!?()])|(?<=[.,;:!?()])(?=[^\W\d_])")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models have for each byte: its own where it has one, the next free from 256 on else."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class Memo:
    """Encodes by the library: texts in batches (encode), or the segments between safe cuts, each once while it is remembered (sums).

    make turns ids into what is kept, which must add up. For sums, words part into letters and the punctuation behind them;
    these go to the library in batches (batched) or words of letters to its merging model itself, as one pre-token; words of
    other kinds go to the library as they are. Two generations of at most CACHE words bound the memory; words around
    a line's end, which seldom repeat, are put together in each call anew and take no room there."""

    def __init__(self, path: str, make, batched: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.make, self.model, self.batched = make, self.library.model, batched
        self.letters = _byte_letters()
        self.plain = _is_byte_level(path)
        back = {c: b for b, c in self.letters.items()}
        self.inner = {(back.get(a), back.get(b)) for t in self.library.get_vocab() for a, b in zip(t, t[1:], strict=False)} if self.plain else set()
        self.new: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.tails: dict[str, object] = {}
        self.line = self.one("\n") if self.plain else None
        self.passing: list[str] = []  # not remembered beyond one call: too long, or put together from what is

    def encode(self, texts: list[str]) -> list:
        """What is kept of each text, encoded in batches; long ones between safe cuts."""
        if self.plain and any(len(t) > LONG for t in texts):
            pieces = [self.chunks(t) if len(t) > LONG else [t] for t in texts]
            known = iter(self.encode_whole([c for p in pieces for c in p]))
            return [reduce(add, [next(known) for _ in p]) for p in pieces]
        return self.encode_whole(texts)

    def encode_whole(self, texts: list[str]) -> list:
        return [self.make(e.ids) for a, b in C.parts([len(t) + 64 for t in texts], 1 << 20) for e in self.library.encode_batch_fast(texts[a:b], add_special_tokens=False)]

    def chunks(self, text: str) -> list[str]:
        """A text cut at safe places about LONG characters apart: at the first white space, turn or byte pair that no token holds; what has none stays whole."""
        out, begin = [], 0
        while len(text) - begin > LONG:
            at = begin + LONG
            m = _GAP.search(text, at, at + LONG) or _TURN.search(text, at, at + LONG)
            cut = m.start() if m else next((k for k in range(at, min(len(text), at + 64 * LONG)) if (text[k - 1].encode()[-1], text[k].encode()[0]) not in self.inner and text[k - 1].isalpha() and text[k].isalpha()), None)
            if cut is None or cut >= len(text):
                cut = m2.start() if (m2 := _GAP.search(text, at + LONG) or _TURN.search(text, at + LONG)) else len(text)
            out.append(text[begin:cut])
            begin = cut
        return [*out, text[begin:]] if begin < len(text) or not out else out

    def one(self, pre_token: str):
        """What is kept of a pre-token: letters behind a space or none, signs, or a line's end."""
        if not pre_token.isascii() or pre_token[0] < " ":
            pre_token = pre_token.encode().decode("latin-1").translate(self.letters)
        elif pre_token[0] == " ":
            pre_token = self.letters[32] + pre_token[1:]
        return self.make([t.id for t in self.model.tokenize(pre_token)])

    def learn(self, words: set[str]) -> dict[str, object]:
        """A dictionary that has all the words: of each, what is kept of it behind a space."""
        for w in self.passing:
            self.new.pop(w, None)
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old, plain, slow, passing = self.new, self.old, self.plain, [], []
        missing = words.difference(new)
        if self.batched:
            self.prepare([w for w in missing if w not in old])
        for w in missing:
            if w in new:
                continue
            if (v := old.get(w)) is not None:
                new[w] = v
            elif plain and w.isalpha() and (w.isascii() or max(w) < _LATIN):
                new[w] = self.one(" " + w)
                if len(w) > 100:
                    passing.append(w)
            elif "\n" in w:
                first, *rest = w.split("\n")
                v = self.letters_of(" ", first)
                for part in rest:  # a line's end between two words is a pre-token of its own
                    u = None if v is None else self.letters_of("", part)
                    v = None if u is None else v + self.line + u
                if v is None:
                    slow.append(w)
                else:
                    new[w] = v
                    passing.append(w)
            elif (v := self.letters_of(" ", w)) is not None:
                new[w] = v
                if len(w) > 100:
                    passing.append(w)
            else:
                slow.append(w)
        new.update(zip(slow, self.encode([" " + w for w in slow]), strict=True))
        self.passing = passing + [w for w in slow if len(w) > 100]
        return new

    def prepare(self, words: list[str]) -> None:
        """Encodes in batches what letters_of will ask for: the letters of these words, and the punctuation behind them."""
        stems, tails = {}, set()
        for w in words:
            for k, part in enumerate(w.split("\n")):
                stem = part.rstrip(TAIL)
                if self.plain and stem.isalpha() and max(stem) < _LATIN:
                    key = "\n" + stem if k else stem
                    if key not in self.new and key not in self.old:
                        stems[key] = stem if k else " " + stem
                    if len(stem) < len(part) < len(stem) + 16:
                        tails.add(part[len(stem) :])
        self.new.update(zip(stems, self.encode_whole(list(stems.values())), strict=True))
        more = [t for t in tails if t not in self.tails]
        self.tails.update(zip(more, self.encode_whole(more), strict=True))

    def letters_of(self, front: str, word: str):
        """What is kept of a word of letters, with the punctuation behind it, in front of which a space may stand; None if it is another kind of word."""
        stem = word.rstrip(TAIL)
        if not (self.plain and stem.isalpha() and (stem.isascii() or max(stem) < _LATIN)):
            return None
        key = stem if front else "\n" + stem
        v = self.new.get(key)
        if v is None:
            v = self.old.get(key)
            if v is None:
                v = self.one(front + stem)
            self.new[key] = v
        if len(stem) < len(word):
            tail = word[len(stem) :]
            t = self.tails.get(tail)
            if t is None:
                t = self.one(tail)
                if len(tail) < 16:
                    if len(self.tails) > 4096:
                        self.tails.clear()
                    self.tails[tail] = t
            v = v + t
        return v

    def sums(self, texts: list[str]) -> list[list]:
        """Of each text, what is kept of its segments, in order."""
        parts = [split(t) for t in texts]
        out = [[v] for v in self.encode([p[0] for p in parts])]
        for a, b in C.parts([len(p) for p in parts], SLICE):
            if b - a > 1 or len(parts[a]) <= SLICE:
                known = self.learn(set().union(*[p[1:] for p in parts[a:b]]))
                for k in range(a, b):
                    out[k] += map(known.__getitem__, parts[k][1:])
            else:
                for at in range(1, len(parts[a]), SLICE):
                    some = parts[a][at : at + SLICE]
                    out[a] += map(self.learn(set(some)).__getitem__, some)
        return out


def _is_byte_level(path: str) -> bool:
    """Whether segments are merged as bytes behind the pattern that SAFE relies on; if not, texts are encoded whole."""
    import json

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre = j.get("pre_tokenizer") or {}
    return j.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and j["model"].get("type") == "BPE" and not any(j["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in j.get("added_tokens", ()))


def memo(path: str, kind: str, make, batched: bool = False) -> Memo:
    if (path, kind, batched) not in _made:
        _made[path, kind, batched] = Memo(path, make, batched)
    return _made[path, kind, batched]


def split(text: str) -> list[str]:
    """Segments of a text between safe cuts; all but the first stood behind a space, which is left out."""
    if "  " in text or " \n" in text or text.endswith(" ") or (any(c in text for c in _WHITE) if text.isascii() else _OTHER.search(text)):
        return SAFE.split(text)
    return text.split(" ")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, special: str = "default") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A path ending in .json goes to the tokenizers library, in .model to sentencepiece; begin, end and added special
    tokens are left out, special strings inside texts are handled as the library does by default. Rows keep their
    partitions (no shuffle); within an Arrow batch, parts of about equal bytes go together: texts are cut at safe places, what
    is not remembered of the segments between is encoded in batches, and only lengths are kept. Null text: empty, 0 bytes and 0 tokens. Null ids stay null; repeated rows each give a row;
    an empty table gives an empty one; further columns are ignored.
    """
    C.session(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only(_made)
        for batch in batches:
            sizes = [len(b) for b in C.blobs(batch.column(1))]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = []
            for a, b in C.parts(sizes, 2 << 20):
                n += _lengths(tokenizer_path, texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return C.texts_of(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _lengths(path: str, texts: list[str]) -> list[int]:
    if path.endswith(".model"):
        if ("sp", path) not in _made:
            import sentencepiece

            _made["sp", path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(x) for x in _made["sp", path].encode(texts, num_threads=1)]
    m = memo(path, "n", len, batched=True)
    return [sum(x) for x in m.sums(texts)] if m.plain else m.encode(texts)
