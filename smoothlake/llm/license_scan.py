"""License scan: template-markup matching beside plain phrases.

A template is words with markup: ``<<beginOptional>> ... <<endOptional>>`` around wording that may be left
out, ``<<var;max=n>>`` for a replaceable region of up to n words. It is compiled into an automaton over
words; it accepts where its mandatory wording stands exactly, word by word. Words are runs of digits, small
letters (A-Z lower-cased) and characters beyond ASCII.

Edge cases: a null or empty text has no words and no labels; very long texts are scanned whole; places where several
phrases or templates begin count for each of them; repeated rows are scanned row by row; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tune

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Fixed values of the contract: phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and template. The wording is that of the licenses' own notices.
TEMPLATES = {
    "mit": [
        "released under the <<beginOptional>>terms of the<<endOptional>> mit license",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ],
    "apache-2.0": [
        "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>",
    ],
    "gpl-2.0": ["licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> version 2"],
    "gpl-3.0": ["licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> version 3"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var;max=60>> this software is provided by <<var;max=12>> as is and any express or implied warranties",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
    "cc-by-nc-4.0": ["licensed under <<beginOptional>>a creative commons<<endOptional>> cc by nc 4 0"],
    "cc-by-sa-4.0": ["licensed under <<beginOptional>>a creative commons<<endOptional>> cc by sa 4 0"],
    "cc-by-4.0": ["licensed under <<beginOptional>>a creative commons<<endOptional>> cc by 4 0"],
    "copyright": ["copyright <<var;max=12>> all rights reserved"],
}

_GNU = "<<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version"
_CC = "<<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> creative commons attribution"

#: The notices as the licenses print them, scanned beside TEMPLATES.
NOTICES = {
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " <<var;max=1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " <<var;max=1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
        " <<beginOptional>><<var;max=1>> all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<var;max=16>><<endOptional>>"
        " <<beginOptional>><<var;max=1>> neither the name of <<var;max=16>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>>"
        " <<beginOptional>><<var;max=1>> the name of <<var;max=16>> may not be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>>"
        " this software is provided by <<var;max=16>> as is and any express or implied warranties",
    ],
    **{
        label: [
            f"under the terms of the gnu {name} public license {_GNU} {version}",
            f"licensed under the gnu {name} public license {_GNU} {version}",
            f"under the terms of version {version} of the gnu {name} public license",
        ]
        for label, name, version in (("gpl-2.0", "general", "2"), ("gpl-3.0", "general", "3"), ("lgpl-2.1", "lesser general", "2 1"), ("lgpl-3.0", "lesser general", "3"))
    },
    **{
        label: [t for kind in kinds for t in (f"licensed under {_CC} {kind} 4 0", f"under the terms of the creative commons attribution {kind} 4 0")]
        for label, kinds in (
            ("cc-by-4.0", ["<<beginOptional>>cc by<<endOptional>>"]),
            ("cc-by-nc-4.0", ["noncommercial <<beginOptional>>cc by nc<<endOptional>>", "non commercial <<beginOptional>>cc by nc<<endOptional>>"]),
            ("cc-by-sa-4.0", ["sharealike <<beginOptional>>cc by sa<<endOptional>>", "share alike <<beginOptional>>cc by sa<<endOptional>>"]),
        )
    },
}


def all_templates() -> dict[str, list[str]]:
    return {label: [*TEMPLATES.get(label, []), *NOTICES.get(label, [])] for label in {**TEMPLATES, **NOTICES}}


MARKUP = re.compile(r"<<(beginOptional|endOptional|var)(?:;max=(\d+))?>>")


@dataclass(frozen=True)
class Automaton:
    """Edges by state: (word, next) and moves without a word. State ``accept`` ends a match."""

    words: tuple[tuple[tuple[bytes, int], ...], ...]
    free: tuple[tuple[int, ...], ...]
    anything: tuple[int | None, ...]
    accept: int
    lead: bytes  # the wording it begins with, for finding places to start


def _words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def compile_template(template: str) -> Automaton:
    words: list[list[tuple[bytes, int]]] = [[]]
    free: list[list[int]] = [[]]
    anything: list[int | None] = [None]
    opened: list[int] = []
    lead: list[bytes] | None = []
    led: list[bytes] = []

    def new() -> int:
        words.append([])
        free.append([])
        anything.append(None)
        return len(words) - 1

    at, place = 0, 0
    for m in [*MARKUP.finditer(template), None]:
        for w in _words(template[place : m.start() if m else len(template)]):
            n = new()
            words[at].append((w, n))
            at = n
            if lead is not None:
                lead.append(w)
        if m is None:
            break
        place = m.end()
        if lead is not None:
            led, lead = lead, None
        if m[1] == "beginOptional":
            opened.append(at)
        elif m[1] == "endOptional":
            n = new()
            free[at].append(n)
            free[opened.pop()].append(n)
            at = n
        else:
            exits = [at]
            for _ in range(int(m[2] or 0)):
                n = new()
                anything[at] = n
                at = n
                exits.append(at)
            end = new()
            for e in exits:
                free[e].append(end)
            at = end
    if opened:
        raise ValueError("an optional region is not closed")
    led = lead if lead is not None else led
    if not led:
        raise ValueError("a template begins with mandatory words")
    return Automaton(tuple(map(tuple, words)), tuple(map(tuple, free)), tuple(anything), at, b" ".join(led))


def accepts(a: Automaton, words: list[bytes], start: int) -> int | None:
    """End of the shortest match that begins at ``start``, or None."""

    def closed(states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for n in a.free[todo.pop()]:
                if n not in states:
                    states.add(n)
                    todo.append(n)
        return states

    now = closed({0})
    i = start
    while now:
        if a.accept in now:
            return i
        if i == len(words):
            return None
        w, nxt = words[i], set()
        for s in now:
            nxt.update(n for x, n in a.words[s] if x == w)
            if a.anything[s] is not None:
                nxt.add(a.anything[s])
        now, i = closed(nxt), i + 1
    return None


def places(joined: bytes, phrase: bytes):
    """Word numbers at which the phrase's words stand, in words joined by blanks with one before and after."""
    at = joined.find(b" " + phrase + b" ")
    seen, last = 0, 0
    while at >= 0:
        seen += joined.count(b" ", last, at)
        last = at
        yield seen
        at = joined.find(b" " + phrase + b" ", at + 1)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.automata = [(label, compile_template(t)) for label, several in templates.items() for t in several]
        self.phrases = [(p.encode(), label) for p, label in phrases.items()]

    def scan(self, text: str | None) -> tuple:
        words = WORD.findall(text.encode().lower()) if text else []
        joined = b" " + b" ".join(words) + b" "
        base: list[int] = []
        base_labels, labels = set(), set()
        for p, label in self.phrases:
            if p in joined:
                at = list(places(joined, p))
                if at:
                    base += at
                    base_labels.add(label)
        for label, a in self.automata:
            if label not in labels and a.lead in joined and any(accepts(a, words, at) is not None for at in places(joined, a.lead)):
                labels.add(label)
        score = 1.0 if labels else 0.5 if base else 0.0
        return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), score)


def scan(documents: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document.
    score: 1 where a template is accepted, one half for phrases alone, else 0."""
    tune(documents.sparkSession)
    templates = templates or all_templates()
    phrases = phrases or PHRASES
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        scanner = Scanner(templates, phrases)
        for b in batches:
            rows = [scanner.scan(t) for t in b.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def template_pattern(template: str) -> str:
    """The template as a regular expression over words that each stand between two blanks of their own."""
    out, place = "", 0
    for m in [*MARKUP.finditer(template), None]:
        out += "".join(f" {w.decode()} " for w in _words(template[place : m.start() if m else len(template)]))
        if m is None:
            return out
        place = m.end()
        out += {"beginOptional": "(?:", "endOptional": ")?", "var": f"(?: [^ ]+ ){{0,{m[2] or 0}}}"}[m[1]]
    return out


def oracle() -> str:
    """The scan in DuckDB's SQL: the same words, phrases by splitting, templates by regular expressions."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    wide = {p: "".join(f" {w} " for w in p.split()) for p in PHRASES}
    count = " + ".join(f"(len(string_split(j, '{x}')) - 1)" for x in wide.values())
    # words before the first place, and before the last one (found in the reversed text)
    blanks = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    first = ", ".join(f"CASE WHEN contains(j, '{x}') THEN {blanks.format(f"substr(j, 1, strpos(j, '{x}') - 1)")} END" for x in wide.values())
    last = ", ".join(
        f"CASE WHEN contains(j, '{x}') THEN {blanks.format(f"substr(j, 1, length(j) - strpos(reverse(j), '{x[::-1]}') - {len(x) - 1})")} END" for x in wide.values()
    )
    base = ", ".join(f"CASE WHEN contains(j, '{wide[p]}') THEN '{label}' END" for p, label in PHRASES.items())
    method = ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(j, '{template_pattern(t)}')" for t in several) + f" THEN '{label}' END" for label, several in all_templates().items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
j AS (SELECT doc_id, len(ws) AS n_words, CASE WHEN len(ws) > 0 THEN ' ' || array_to_string(ws, '  ') || ' ' ELSE '' END AS j FROM w),
l AS (SELECT doc_id, n_words, {count} AS n_base, least({first}) AS first_word, greatest({last}) AS last_word,
  list_filter([{base}], lambda x: x IS NOT NULL) AS b, list_filter([{method}], lambda x: x IS NOT NULL) AS m FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(b)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(b, m))), ',') AS labels,
  CASE WHEN len(m) > 0 THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM l"""
