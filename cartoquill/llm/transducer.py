"""SentencePiece encoding and decoding (op 2) by a weighted finite-state transducer over the tropical semiring.

A model is compiled to two transducers. The normaliser rewrites characters: the longest rule of the model's map, white space
to U+2581, runs of it to one and an edge to none where the model says so; its states are the map's trie and whether white
space came last. The lexicon reads normal characters along the pieces' trie and writes ids with weights, bytes for
characters that are no piece. Both are composed with each input, and the path of least weight gives the ids.

For a unigram model a piece weighs its negative score. For a BPE model scores cannot be weights, as merging the best pair
first is no sum. Its language is bigram-local, though: a sequence of pieces is the result of merging exactly if each two
neighbours, by themselves, merge to just these two. So there the lexicon's states remember the last piece, arcs to a
neighbour that would merge otherwise weigh infinity (the semiring's zero), all others 1: the shortest path is the result.
These weights are compiled when an input first asks for them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

SPACE = "▁"
# Fixed values of the model format: piece kinds, model types; what an unknown character weighs beyond the rarest piece.
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
CACHE, PAIRS = 250_000, 500_000
#: The tropical semiring: plus is min, times is addition, ZERO leads nowhere, ONE costs nothing.
ZERO, ONE = float("inf"), 0.0
_made: dict[str, "Transducer"] = C.kept()


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: (number, integer or bytes)."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, b[i : i + n]
            i += n


class Normaliser:
    """The transducer from texts to normal texts; rules are kept as the model has them, a double-array trie over UTF-8 and the strings its leaves name."""

    def __init__(self, rules: bytes, dummy: bool, squeeze: bool, whole: list[str]):
        self.dummy, self.squeeze = dummy, squeeze
        self.whole = re.compile("|".join(map(re.escape, sorted(whole, key=len, reverse=True)))) if whole else None
        size = int.from_bytes(rules[:4], "little")
        self.units = np.frombuffer(rules, "<u4", size // 4, 4).tolist() if rules else []
        self.strings = rules[4 + size :]
        self.plain = not (rules or squeeze or whole)
        self.known: dict[str, tuple[str, int]] = {}

    def rule(self, text: str, at: int) -> tuple[str, int]:
        """What the longest rule at a place writes and how many characters it reads; without a rule, the character itself."""
        if not self.units:
            return text[at], 1
        unit, state, best = self.units[0], 0, (text[at], 1)
        state = (unit >> 10) << ((unit & 512) >> 6)
        for n in range(at, len(text)):
            for byte in text[n].encode():
                state ^= byte
                unit = self.units[state] if state < len(self.units) else 0
                if unit & 0x800000FF != byte:
                    return best
                state ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                begin = self.units[state] & 0x7FFFFFFF
                best = self.strings[begin : self.strings.index(b"\0", begin)].decode(), n + 1 - at
        return best

    def run(self, text: str) -> str:
        if self.plain:
            return SPACE * self.dummy + text.replace(" ", SPACE) if text else ""
        out, at, spaced = [], 0, self.squeeze
        while at < len(text):
            held = self.whole.match(text, at) if self.whole else None
            piece, n = (held[0], len(held[0])) if held else self.rule(text, at)
            at += n
            if spaced:
                piece = piece.lstrip(" ")
            if piece:
                out.append(piece.replace(" ", SPACE))
                spaced = self.squeeze and piece.endswith(" ")
        normal = "".join(out)
        if self.squeeze:
            normal = normal.rstrip(SPACE)
        return SPACE * self.dummy + normal if normal else ""


class Transducer:
    """A compiled model: normaliser, lexicon and byte fallback, and its inverse."""

    def __init__(self, path: str):
        self.text: list[str] = []
        self.piece: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        self.bytes_of: dict[int, bytes] = {}
        self.silent: set[int] = set()
        self.unknown, self.surface, whole = 0, " ⁇ ", []
        kind_of_model, fallback, dummy, squeeze, escape, rules = UNIGRAM, 0, 1, 1, 1, b""
        with open(path, "rb") as f:
            model = f.read()
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                text, kind, i = p[1].decode(), p.get(3, NORMAL), len(self.text)
                self.text.append(text)
                if kind in (NORMAL, USER):
                    self.piece[text] = i
                    self.rank[text] = float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0])
                    if kind == USER:
                        whole.append(text)
                elif kind == BYTE:
                    self.byte[int(text[3:5], 16)] = i
                    self.bytes_of[i] = bytes([int(text[3:5], 16)])
                elif kind == UNUSED:
                    raise ValueError("models with unused pieces are not compiled")
                else:
                    self.silent.add(i)
                    if kind == UNKNOWN:
                        self.unknown = i
            elif field == 2:
                spec = dict(_fields(value))
                kind_of_model, fallback = spec.get(3, UNIGRAM), spec.get(35, 0)
                self.surface = spec[44].decode() if 44 in spec else self.surface
                if spec.get(24, 0):
                    raise ValueError("models with white space as a suffix are not compiled")
            elif field == 3:
                spec = dict(_fields(value))
                dummy, squeeze, escape, rules = spec.get(3, 1), spec.get(4, 1), spec.get(5, 1), spec.get(2, b"")
        if not self.text:
            raise ValueError("the file holds no pieces")
        if kind_of_model not in (UNIGRAM, BPE) or not escape or fallback and len(self.byte) != 256 or kind_of_model == BPE and whole:
            raise ValueError("only unigram and BPE models that escape white space; BPE models without user-defined pieces")
        self.bpe, self.fallback = kind_of_model == BPE, bool(fallback)
        self.normaliser = Normaliser(rules, bool(dummy), bool(squeeze), whole)
        self.dummy = bool(dummy)
        # The lexicon: a trie of the pieces, arcs by character, and under "" the piece that ends there.
        self.arcs: dict = {}
        for p in self.piece:
            node = self.arcs
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        high, low = max(self.rank.values(), default=0.0), min(self.rank.values(), default=0.0)
        self.weight = {p: np.float32(-s) for p, s in self.rank.items()} | {p: -(np.float32(len(p.encode())) * np.float32(high) - np.float32(0.1)) for p in whole}
        self.unknown_weight = -(np.float32(low) - np.float32(UNKNOWN_PENALTY))
        self.output = [self.bytes_of.get(i) or (b"" if i in self.silent else x.encode()) for i, x in enumerate(self.text)]
        if not self.fallback:
            self.output[self.unknown] = self.surface.encode()
        self.inner = {p[k : k + 2] for p in self.piece for k in range(len(p) - 1)}
        self.by_words = self.bpe and all(SPACE not in p.lstrip(SPACE) for p in self.piece)  # no piece spans the front of a word
        self.pairs: dict[str, dict[str, float]] = {}
        self.n_pairs = 0
        self.words, self.old_words = {}, {}  # two generations of at most CACHE each bound the memory
        self.runs, self.old_runs = {}, {}

    # ---- compilation, as far as inputs reach

    def merged(self, text: str) -> list[str]:
        """Symbols after merging the best pair first, the leftmost of equals; it decides which pieces may follow each other."""
        symbols, rank = list(text), self.rank
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                r = rank.get(symbols[k] + symbols[k + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def follows(self, last: str, piece: str) -> float:
        """The weight of a BPE model's arc that reads a piece in the state after another ("": the start); kept, as many as PAIRS."""
        if last and last + piece in self.rank:
            known = False
        elif last and last[-1] + piece[0] not in self.inner:
            known = self.merged(piece) == [piece]
        else:
            known = self.merged(last + piece) == ([last, piece] if last else [piece])
        if self.n_pairs >= PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        weight = self.pairs.setdefault(last, {})[piece] = 1.0 if known else ZERO
        self.n_pairs += 1
        return weight

    # ---- composition and shortest path

    def leaving(self, run: str, at: int) -> list[str]:
        """What the lexicon reads from a place of a run: the pieces that begin there, or else (or besides) the one character."""
        node, out, j = self.arcs, [], at
        while j < len(run) and (node := node.get(run[j])) is not None:
            j += 1
            if "" in node:
                out.append(node[""])
        return out if out and len(out[0]) == 1 else [run[at], *out]

    def shortest(self, run: str) -> list[int]:
        """Ids of the shortest path through the lexicon composed with a run of normal characters."""
        ids: list[int] = []
        for p in self.furthest(run) if self.bpe else self.settled(run):
            i = self.piece.get(p)
            if i is not None:
                ids.append(i)
            elif self.fallback:
                ids += [self.byte[b] for b in p.encode()]
            elif not ids or ids[-1] != self.unknown:  # unknown characters side by side are one
                ids.append(self.unknown)
        return ids

    def settled(self, run: str) -> list[str]:
        """The shortest path, by settling the composition's states (places, with the last piece for a BPE model) in order of places. Of paths of equal weight the one that came first stays."""
        reached: list[dict] = [{} for _ in range(len(run) + 1)]
        reached[0][""] = (ONE, 0, "")
        pairs, weight, unknown = self.pairs, self.weight, self.unknown_weight
        for at in range(len(run)):
            states = reached[at]
            if not states:
                continue
            for p in self.leaving(run, at):
                ahead = reached[at + len(p)]
                if self.bpe:
                    least, by = ZERO, None
                    for last, (w, _, _) in states.items():
                        step = pairs.get(last, {}).get(p)
                        if (w := w + (self.follows(last, p) if step is None else step)) < least:
                            least, by = w, last
                    if by is not None:
                        ahead[p] = (least, at, by)
                else:
                    w = states[""][0] + weight.get(p, unknown)
                    if "" not in ahead or w < ahead[""][0]:
                        ahead[""] = (w, at, p)
        at, path = len(run), []
        if not reached[at]:
            raise ValueError(f"no path through {run!r}")
        state = min(reached[at], key=lambda s: reached[at][s][0])
        while at:
            _, before, name = reached[at][state]
            path.append(state if self.bpe else name)
            at, state = before, name if self.bpe else ""
        return path[::-1]

    def furthest(self, run: str) -> list[str]:
        """The same path of a BPE model, by a search that takes the longest arcs first.

        At most one path of finite weight leads to each place, so the first that reaches the end is the shortest, and a place
        that has turned out to lead nowhere is never entered again."""
        n, pairs, dead, stack, path = len(run), self.pairs, set(), [], []
        at, state, options = 0, "", None
        while at < n:
            if options is None:
                options = self.leaving(run, at)
            known = pairs.get(state)
            while options:
                p = options.pop()
                if at + len(p) not in dead:
                    weight = known.get(p) if known is not None else None
                    if (self.follows(state, p) if weight is None else weight) < ZERO:
                        stack.append((at, state, options))
                        path.append(p)
                        at, state, options = at + len(p), p, None
                        break
            else:
                dead.add(at)
                if not stack:
                    raise ValueError(f"no path through {run!r}")
                at, state, options = stack.pop()
                path.pop()
        return path

    def word(self, word: str) -> bytes:
        """Ids (i32) of a run that begins with white space; cut where no piece spans two neighbours."""
        ids, begin, inner, runs = [], 0, self.inner, self.runs
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inner] if self.fallback else []
        for k in (*cuts, len(word)):
            run = word[begin:k]
            known = runs.get(run)
            if known is None:
                known = self.old_runs.get(run) or self.shortest(run)
                if len(run) <= 40:
                    runs[run] = known
            ids += known
            begin = k
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        if not self.by_words or not self.fallback:
            normal = self.normaliser.run(text)
            return np.array(self.shortest(normal) if normal else [], "<i4")
        if not self.normaliser.plain or SPACE in text or "  " in text or text[0] == " " or text[-1] == " " or not self.dummy:
            words = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", self.normaliser.run(text))
        else:
            words = [SPACE + w for w in text.split(" ")]
        if len(self.words) >= CACHE:
            self.old_words, self.words = self.words, {}
        if len(self.runs) >= CACHE:
            self.old_runs, self.runs = self.runs, {}
        known, old = self.words, self.old_words
        for w in set(words).difference(known):
            known[w] = old.get(w) or self.word(w)
        out = b"".join(map(known.__getitem__, words))
        for w in [w for w in known if len(w) > 60] if len(text) > 1 << 16 else ():
            del known[w]
        return np.frombuffer(out, "<i4")

    def decode(self, ids: list[int]) -> str:
        """Text of ids, by the lexicon's inverse: byte pieces join to UTF-8 (U+FFFD for what is none), white space is put back, what the normaliser has put in front dropped."""
        begin = 0
        while begin < len(ids) and (self.normaliser.squeeze and self.text[ids[begin]] == SPACE or ids[begin] in self.silent and ids[begin] != self.unknown):
            begin += 1
        first = begin < len(ids) and (self.dummy or self.normaliser.squeeze) and self.text[ids[begin]].startswith(SPACE)
        out = b"".join(map(self.output.__getitem__, ids[begin:] if begin else ids)).decode(errors="replace").replace(SPACE, " ")
        return out[1:] if first else out


def transducer(path: str) -> Transducer:
    if path not in _made:
        _made[path] = Transducer(path)
    return _made[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, ids (if asked for), n_ids, ids_crc32 (of the ids as little-endian i32), decoded_sha256, round_trip.

    Whole texts, without begin and end. decoded_sha256 is of the text decoded from the ids; round_trip says that it equals
    the input (not so where that holds U+2581, which stands for a space, or where the model normalises it away). Null text:
    empty, no ids. Very long texts are encoded word by word under a BPE model with byte fallback. Rows keep their
    partitions; repeated rows each give a row; an empty table an empty one; further columns, of any name, are ignored.
    """
    C.session(docs)
    kept = "ids array<int>, " * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only(_made)
        t = transducer(model_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in C.parts([len(x) for x in texts], 2 << 20):
                some = texts[a:b]
                ids = [t.encode(x) for x in some]
                decoded = [t.decode(x.tolist()) for x in ids]
                arrays = {"doc_id": batch.column(0).slice(a, b - a)}
                if with_ids:
                    arrays["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                arrays |= {
                    "n_ids": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                    "round_trip": pa.array([x == y for x, y in zip(some, decoded, strict=True)], pa.bool_()),
                }
                yield pa.RecordBatch.from_pydict(arrays)

    return C.texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {kept}n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
