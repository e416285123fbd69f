"""License scans: licence notices found by templates with optional and replaceable wording.

A template is its wording with markup: `<<opt: words>>` may be left out, `<<var: most>>` stands for up to `most` words
of any kind (names, years). It is compiled into an automaton over words; a place in a text is accepted where all
mandatory words follow each other exactly, with nothing between them but what the markup allows. Optional wording at
either end decides nothing and is left out of the automaton. Runs start only where the leading mandatory words stand,
and live for as many words as the template has at most, so a text costs its length and its beginnings.

Base phrases are templates without markup. Words are runs of digits, letters a-z (A-Z are lower-cased) and signs beyond
ASCII. Null and empty texts have no words and no labels; texts of any length are read whole, one at a time. Each row is
judged by itself, so ties, repeated rows and null ids need no rule; other columns are kept, and columns of the new names
replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from plumbline.llm.texts import grouped, terms, utf8

@dataclass(frozen=True)
class Template:
    """label: of what is accepted; wording: with markup; weight: the score of a text in which it is the best find."""

    label: str
    wording: str
    weight: float


#: The phrases of the base, the notices in common use and the licences' own wording.
BASE = (
    Template("mit", "mit license", 0.5),
    Template("apache", "apache license", 0.5),
    Template("gpl", "general public license", 0.5),
)
TEMPLATES = (
    Template("mit", "<<opt:is>> released under the <<opt:terms of the>> mit license", 0.8),
    Template("mit", "<<opt:is>> licensed under the <<opt:terms of the>> mit license", 0.8),
    Template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
        sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<opt:including the next paragraph>> shall be included in all copies or substantial portions of the software""", 1.0),
    Template("apache-2.0", "licensed under the apache license version 2 0 <<opt:the license>>", 0.9),
    Template("apache-2.0", """licensed under the apache license version 2 0 the license you may not use <<var:3>> except in compliance with the license
        you may obtain a copy of the license at http<<opt:s>> www apache org licenses license 2 0""", 1.0),
    Template("gpl-2.0", "licensed under the <<opt:terms of the>> gnu general public license <<opt:gpl>> version 2", 0.9),
    Template("gpl-3.0", "licensed under the <<opt:terms of the>> gnu general public license <<opt:gpl>> version 3", 0.9),
    Template("gpl-2.0-or-later", """you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
        either version 2 of the license or <<opt:at your option>> any later version""", 1.0),
    Template("gpl-3.0-or-later", """you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
        either version 3 of the license or <<opt:at your option>> any later version""", 1.0),
    Template("lgpl", "gnu <<opt:lesser>> <<opt:library>> general public license as published by the free software foundation <<var:10>> lgpl", 0.9),
    Template("bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<opt:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<opt:2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution""", 1.0),
    Template("bsd-3-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<opt:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<opt:2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution <<opt:3>> neither the name of <<var:30>> may be used to endorse or promote products derived from this
        software without specific prior written permission""", 1.0),
    Template("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""", 1.0),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    Template("cc-by", "licensed under <<opt:a>> <<opt:the>> <<opt:terms of the>> creative commons attribution <<opt:4 0>> <<opt:international>> license", 0.9),
    Template("cc-by", "licensed under cc by <<var:1>> 0", 0.9),
    Template("cc-by-nc", "licensed under cc by nc <<var:1>> 0", 0.9),
    Template("cc-by-sa", "licensed under cc by sa <<var:1>> 0", 0.9),
    Template("cc-by-nd", "licensed under cc by nd <<var:1>> 0", 0.9),
    Template("all-rights-reserved", "copyright <<opt:c>> <<var:30>> all rights reserved", 0.6),
)


class Automaton(NamedTuple):
    """lead: the leading mandatory words. words: of the states, None for any word. after: the states that may follow
    each state, -1 for acceptance; state 0 stands behind the lead."""

    lead: tuple[bytes, ...]
    words: list[bytes | None]
    after: list[tuple[int, ...]]

    def ends(self, text: list[bytes], start: int) -> int | None:
        """Where the shortest accepted run behind a lead at `start` ends (exclusive), or None."""
        at, live = start + len(self.lead), self.after[0]
        while live:
            if -1 in live:
                return at
            if at >= len(text):
                return None
            word = text[at]
            live = tuple({n for s in live if self.words[s] is None or self.words[s] == word for n in self.after[s]})
            at += 1
        return None


MARK = re.compile(r"<<(opt|var):([^<>]*)>>")


def parts(wording: str) -> list[tuple[str, list[bytes] | int]]:
    """('must', words), ('opt', words) and ('var', most) in order, without optional parts at either end."""
    out: list[tuple[str, list[bytes] | int]] = []
    at = 0
    for m in [*MARK.finditer(wording), None]:
        if plain := terms(wording[at : m.start() if m else None].encode()):
            out.append(("must", plain))
        if m:
            out.append((m[1], terms(m[2].encode()) if m[1] == "opt" else int(m[2])))
            at = m.end()
    while out and out[0][0] != "must":
        out.pop(0)
    while out and out[-1][0] != "must":
        out.pop()
    if not out:
        raise ValueError(f"no mandatory wording: {wording!r}")
    return out


def compiled(template: Template) -> Automaton:
    """The automaton of a template: a state a word, and edges that pass over what may be left out."""
    (_, lead), *rest = parts(template.wording)
    words: list[bytes | None] = [b""]
    after: list[set[int]] = [set()]
    open_ends = {0}  # states from which the next part may begin

    def step(word: bytes | None, sources: set[int]) -> int:
        words.append(word)
        after.append(set())
        for s in sources:
            after[s].add(len(words) - 1)
        return len(words) - 1

    for kind, what in rest:
        sources, passed = open_ends, set(open_ends)
        for word in [None] * what if kind == "var" else what:
            sources = {step(word, sources)}
            if kind == "var":
                passed |= sources
        open_ends = sources if kind == "must" else sources | passed
    for s in open_ends:
        after[s].add(-1)
    return Automaton(tuple(lead), words, [tuple(x) for x in after])


class Found(NamedTuple):
    label: str
    start: int
    end: int
    weight: float


def places(line: bytes, lead: bytes) -> Iterator[int]:
    """Word numbers at which lead (with a space before and behind) stands in line (the words, likewise)."""
    at, word, counted = line.find(lead), 0, 0
    while at >= 0:
        word += line.count(b" ", counted, at)
        counted = at
        yield word
        at = line.find(lead, at + 1)


def scan(words: list[bytes], line: bytes, automata: list[tuple[Template, Automaton]]) -> list[Found]:
    """What the templates accept, by template and place."""
    out = []
    for template, automaton in automata:
        for start in places(line, b" " + b" ".join(automaton.lead) + b" "):
            end = automaton.ends(words, start)
            if end is not None:
                out.append(Found(template.label, start, end, template.weight))
    return out


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[Template, ...] = BASE, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and found: an array of label, start,
    end (words, end exclusive) of the templates' places. score is the weight of the best find, 0 without one."""
    find = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    new = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "found": find}
    names = [c for c in docs.columns if c not in new]
    at = names.index(text_col)
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType(), find: T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))}
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, kinds[k]) for c, k in new.items())])
    base_automata, automata = ([(t, compiled(t)) for t in some] for some in (base, templates))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, at):
            out: dict[str, list] = {c: [] for c in new}
            for text in utf8(batch.column(at)):
                words = terms(text)
                line = b" " + b" ".join(words) + b" "
                plain, more = scan(words, line, base_automata), scan(words, line, automata)
                starts = [f.start for f in plain]
                row = (len(words), len(plain), min(starts, default=None), max(starts, default=None), joined(plain), joined(plain + more), max((f.weight for f in plain + more), default=0.0), [{"label": f.label, "start": f.start, "end": f.end} for f in more])
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[c], k) for c, k in new.items())], names=[*names, *new])

    return docs.select(*names).mapInArrow(judge, schema)


def joined(found: list[Found]) -> str:
    return ",".join(sorted({f.label for f in found}))
