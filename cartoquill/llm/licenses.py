"""License scans (op 9): template markup compiled to token automata, beside plain phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Lower-cases A-Z and blanks what parts words: all below 0x80 but digits and letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Phrases and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Templates and their labels (fixed values; the wording of the licences and notices): [[ ... ]] is optional wording, <<n>> stands for up to n words of any kind.
TEMPLATES = (
    ("mit-notice", "[[this work is]] released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of <<12>> to deal in <<6>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", """[[the]] [[mit license]] [[mit]] [[copyright <<16>>]] Permission is hereby granted, free of charge, to any person obtaining a copy of <<8>> (the "<<2>>"), to deal
        in <<3>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of <<3>>, and to permit persons
        to whom <<3>> is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included
        in all copies or substantial portions of <<3>>. <<2>> is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
        merchantability, fitness for a particular purpose and noninfringement. In no event shall <<8>> be liable for any claim, damages or other liability, whether in an action of contract,
        tort or otherwise, arising from, out of or in connection with <<3>> or the use or other dealings in <<3>> [[software]]"""),
    ("mit-0", """[[mit no attribution]] [[copyright <<16>>]] Permission is hereby granted, free of charge, to any person obtaining a copy of <<8>> (the "<<2>>"), to deal in <<3>> without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of <<3>>, and to permit persons to whom <<3>> is furnished to do so.
        <<2>> is provided "as is", without warranty of any kind"""),
    ("isc", """[[isc license]] [[copyright <<16>>]] Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. The software is provided "as is" and <<6>> disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness. In no event shall <<6>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or
        profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"""),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", """[[copyright <<16>>]] [[all rights reserved]] Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. [[[[3]] [[4]] Neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission.]] This software is provided by <<8>> "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed. In no event shall <<8>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to,
        procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or
        tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"""),
    ("bsd-3-clause", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. [[3]] [[4]] Neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"""),
    ("apache-2.0", "licensed under the apache license version 2.0 [[the license]]"),
    ("apache-2.0-header", """[[copyright <<16>>]] Licensed under the Apache License, Version 2.0 [[(the "License")]]; you may not use this file except in compliance with the License. You may obtain a copy of the License at
        [[http https]] [[http]] [[https]] [[www]] apache org licenses LICENSE 2.0 [[html]] [[txt]] Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "as is" basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License"""),
    ("gpl-notice", "[[this work is]] licensed under the [[gnu]] general public license [[version <<1>> [[or later]]]]"),
    ("gpl-notice", "under the terms of the gnu general public license as published by the free software foundation [[either]] version <<1>>"),
    ("gpl-header", """[[This program]] <<6>> is free software [[:]] you can redistribute it and/or modify it under the terms of the GNU [[Lesser]] [[Affero]] General Public License as published by the Free Software
        Foundation [[, either]] version <<2>> of the License [[, or (at your option) any later version]]. <<6>> is distributed in the hope that it will be useful, but without any warranty; without even the
        implied warranty of merchantability or fitness for a particular purpose. See the GNU [[Lesser]] [[Affero]] General Public License for more details [[You should have received a copy of the GNU [[Lesser]]
        [[Affero]] General Public License along with <<4>>]]"""),
    ("cc-by-nc-4.0", "licensed under [[a]] [[creative commons]] [[cc]] [[attribution]] by nc 4.0 [[international]]"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means"""),
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Automaton:
    """Accepts a run of words: the key (the longest run of mandatory words outside of regions), and what stands before and after it.

    before and after are non-deterministic automata with states 0 ... n; steps[s] is (word or None for any, next state) and
    skips[s] the states reached without a word. before reads words backwards from the key."""

    label: str
    key: bytes
    size: int
    before: tuple[list, list]
    after: tuple[list, list]

    def accepts(self, words: list[bytes], at: int) -> tuple[int, int] | None:
        """The words [first, end) of the longest run that is accepted with its key at a place."""
        end = _longest(self.after, words, at + self.size, 1)
        first = _longest(self.before, words, at - 1, -1)
        return None if end is None or first is None else (first + 1, end)


def _longest(machine: tuple[list, list], words: list[bytes], at: int, step: int) -> int | None:
    steps, skips = machine
    final, states, best = len(steps) - 1, _closed({0}, skips), None
    while True:
        if final in states:
            best = at
        if not 0 <= at < len(words):
            return best
        states = _closed({to for s in states for word, to in steps[s] if word is None or word == words[at]}, skips)
        if not states:
            return best
        at += step


def _closed(states: set[int], skips: list) -> set[int]:
    todo = list(states)
    while todo:
        for to in skips[todo.pop()]:
            if to not in states:
                states.add(to)
                todo.append(to)
    return states


def tree(template: str) -> list:
    """Words, ("any", n) and ("optional", [...]) of template markup."""
    stack: list[list] = [[]]
    for token in re.findall(r"\[\[|\]\]|<<\d+>>|(?:(?!\[\[|\]\]|<<)\S)+", template):
        if token == "[[":
            stack.append([])
        elif token == "]]":
            if len(stack) < 2:
                raise ValueError(f"]] without [[ in {template!r}")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif token.startswith("<<"):
            stack[-1].append(("any", int(token[2:-2])))
        else:
            stack[-1] += words_of(token.encode())
    if len(stack) > 1:
        raise ValueError(f"[[ without ]] in {template!r}")
    return stack[0]


def machine(items: list) -> tuple[list, list]:
    steps: list[list] = [[]]
    skips: list[list] = [[]]

    def new() -> int:
        steps.append([])
        skips.append([])
        return len(steps) - 1

    def build(items: list, at: int) -> int:
        for x in items:
            if isinstance(x, bytes):
                to = new()
                steps[at].append((x, to))
            elif x[0] == "any":
                places = [at] + [new() for _ in range(x[1])]
                for a, b in zip(places, places[1:], strict=False):
                    steps[a].append((None, b))
                to = new()
                for a in places:
                    skips[a].append(to)
            else:
                inner = build(x[1], at)
                to = new()
                skips[inner].append(to)
                skips[at].append(to)
            at = to
        return at

    final = build(items, 0)
    if final != len(steps) - 1:
        last = new()
        skips[final].append(last)
    return steps, skips


def _reversed(items: list) -> list:
    return [x if isinstance(x, bytes) or x[0] == "any" else ("optional", _reversed(x[1])) for x in reversed(items)]


def compile_template(label: str, template: str) -> Automaton:
    items = tree(template)
    runs, begin = [], None
    for i, x in enumerate([*items, ("end", 0)]):
        if isinstance(x, bytes):
            begin = i if begin is None else begin
        elif begin is not None:
            runs.append((i - begin, -begin))
            begin = None
    if not runs:
        raise ValueError(f"{label}: no mandatory wording")
    size, start = max(runs)
    start = -start
    return Automaton(label, b" ".join(items[start : start + size]), size, machine(_reversed(items[:start])), machine(items[start + size :]))


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Places in words where a phrase stands, in words joined by a space with one at either end."""
    out, at, words, last = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", last, at)
        last = at
        out.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def scan(text: bytes, phrases, automata) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, score, and of each template's label the first longest run it accepts, of one text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    found, base = [], set()
    for phrase, label in phrases:
        if at := places(joined, phrase):
            found += at
            base.add(label)
    runs: dict[str, tuple[int, int]] = {}
    for a in automata:
        if a.key in joined:
            for k in places(joined, a.key):
                if run := a.accepts(words, k):
                    held = runs.get(a.label)
                    runs[a.label] = min(run, held, key=lambda r: (r[0], -r[1])) if held else run
                    break
    score = 1.0 if runs else 0.5 if base else 0.0
    spans = ",".join(f"{label}:{first}-{end}" for label, (first, end) in sorted(runs.items()))
    return len(words), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(base)), ",".join(sorted(base | runs.keys())), score, spans


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base (places of phrases), first_word and last_word (smallest and largest start, else null),
    base_labels, labels (phrases and templates), score (1: a template's mandatory wording matches, 0.5: phrases only, 0: neither),
    spans (label:first-end of the first run of words that each template's label accepts, with its optional wording).

    Null text: empty, no words and labels. Places of different phrases that coincide each count. Very long texts are
    searched whole, automata run only where their longest mandatory wording stands. Rows keep their partitions; repeated
    rows each give a row; an empty table an empty one; further columns, of any name, are ignored.
    """
    C.session(docs)
    plain = [(b" ".join(words_of(p.encode())), label) for p, label in phrases]
    automata = [compile_template(*t) for t in templates]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        for batch in batches:
            yield C.table_rows(schema, [(i, *scan(t, plain, automata)) for i, t in zip(batch.column(0).to_pylist(), C.blobs(batch.column(1)), strict=True)])

    return C.texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
