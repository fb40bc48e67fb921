"""License scan: ordered signature rules over the words of a text.

A rule is a regular expression over the lower-cased words joined by single spaces, with a keyword
that must occur before the expression is tried, a priority, and a label. Where detections overlap,
the one of higher priority suppresses those whose interval it contains.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose places are counted, with their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Label, names. A name is a pattern over words; (?: ...)? are optional words.
FAMILIES = [
    ("mit", ["(?:the )?mit licen[cs]e", "(?:the )?expat licen[cs]e", "mit x11 licen[cs]e"]),
    ("mit-0", ["mit no attribution(?: licen[cs]e)?", "mit 0 licen[cs]e"]),
    ("apache-1.1", ["apache (?:software )?licen[cs]e (?:version )?1 1"]),
    ("apache-2", ["apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?",
                             "apache 2(?: 0)? licen[cs]e"]),
    ("bsd-2-clause", ["(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e",
                              "bsd (?:2|two) clause(?: licen[cs]e)?"]),
    ("bsd-3-clause", ["(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e",
                              "bsd (?:3|three) clause(?: licen[cs]e)?"]),
    ("bsd-4-clause", ["(?:original|4 clause|four clause) bsd licen[cs]e"]),
    ("bsd", ["bsd (?:style )?licen[cs]e"]),
    ("gpl-1", ["gnu general public licen[cs]e (?:as published [a-z ]{0,40})?(?:version |v)1",
                     "gpl ?(?:version |v)?1(?: 0)?"]),
    ("gpl-2", ["gnu general public licen[cs]e (?:version |v)2(?: 0)?",
                     "(?:gnu )?gpl (?:version |v)?2(?: 0)?", "gplv2"]),
    ("gpl-3", ["gnu general public licen[cs]e (?:version |v)3(?: 0)?",
                     "(?:gnu )?gpl (?:version |v)?3(?: 0)?", "gplv3"]),
    ("gpl", ["gnu general public licen[cs]e", "gnu gpl"]),
    ("lgpl-2.1", ["gnu lesser general public licen[cs]e (?:version |v)2 1",
                        "lgpl (?:version |v)?2 1"]),
    ("lgpl-3", ["gnu lesser general public licen[cs]e (?:version |v)3(?: 0)?",
                      "lgpl (?:version |v)?3(?: 0)?", "lgplv3"]),
    ("lgpl", ["gnu (?:lesser|library) general public licen[cs]e"]),
    ("agpl-3", ["gnu affero general public licen[cs]e (?:version |v)3(?: 0)?",
                      "agpl (?:version |v)?3(?: 0)?", "agplv3"]),
    ("agpl", ["(?:gnu )?affero general public licen[cs]e"]),
    ("mpl-1.1", ["mozilla public licen[cs]e (?:version |v)?1 1", "mpl 1 1"]),
    ("mpl-2", ["mozilla public licen[cs]e (?:version |v)?2(?: 0)?", "mpl 2 0"]),
    ("epl-1", ["eclipse public licen[cs]e (?:version |v)?1(?: 0)?"]),
    ("epl-2", ["eclipse public licen[cs]e (?:version |v)?2(?: 0)?"]),
    ("eupl-1.2", ["european union public licen[cs]e (?:version |v)?1 2", "eupl 1 2"]),
    ("cddl-1", ["common development and distribution licen[cs]e", "cddl (?:version )?1 [01]"]),
    ("artistic-2", ["artistic licen[cs]e (?:version )?2(?: 0)?"]),
    ("isc", ["isc licen[cs]e"]),
    ("zlib", ["zlib(?: libpng)? licen[cs]e"]),
    ("boost-1", ["boost software licen[cs]e(?: (?:version )?1 0)?"]),
    ("unlicense", ["the unlicense"]),
    ("wtfpl", ["wtfpl"]),
    ("python-2", ["python software foundation licen[cs]e(?: version 2)?", "psf licen[cs]e"]),
    ("openssl", ["openssl licen[cs]e"]),
    ("ofl-1.1", ["sil open font licen[cs]e", "ofl 1 1"]),
    ("cc0-1", ["cc0(?: 1 0)?", "creative commons zero(?: 1 0)?"]),
    ("cc-by", ["cc by", "creative commons attribution"]),
    ("cc-by-sa", ["creative commons attribution sharealike"]),
    ("cc-by-sa", ["cc by sa"]),
    ("cc-by-nd", ["cc by nd"]),
    ("cc-by-nc", ["cc by nc"]),
    ("cc-by-nc", ["creative commons attribution non ?commercial"]),
    ("cc-by-nc-sa", ["cc by nc sa"]),
    ("cc-by-nc-nd", ["cc by nc nd"]),
    ("odbl", ["open (?:data commons open )?database licen[cs]e", "odbl"]),
]

# How a name is used, with priority and confidence.
USES = [
    ("{}", 20, 0.5),
    ("{} (?:or|and) (?:any )?later(?: version)?", 30, 0.6),
    ("under (?:the )?(?:terms of )?(?:the |a )?{}", 40, 0.8),
    ("licen[cs]ed under (?:the )?(?:terms of )?(?:the |a )?{}", 60, 0.95),
    ("(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the |a )?{}",
     50, 0.9),
    ("spdx licen[cs]e identifier {}", 70, 1.0),
]

# Sentences of license texts and notices, with priority and confidence.
SENTENCES = [
    # permissive grants
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 80, 1.0),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", 72, 0.8),
    ("mit-0", "to deal in the software without restriction including without limitation the rights to use "
     "copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so the software is provided", 82, 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 80, 1.0),
    ("0bsd", "for any purpose with or without fee is hereby granted the software is provided as is", 82, 0.9),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation", 80, 0.9),
    ("ncsa", "to deal with the software without restriction", 80, 0.9),
    ("postgresql", "without a written agreement is hereby granted provided that the above copyright notice", 80, 0.9),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without "
     "fee is hereby granted provided that", 81, 0.8),
    ("fsfap", "copying and distribution of this file with or without modification are permitted", 78, 0.9),
    ("unicode", "a copy of the unicode data files", 80, 0.9),
    ("ijg", "permission is hereby granted to use copy modify and distribute this software or portions thereof",
     80, 0.9),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", 80, 1.0),
    ("fair", "usage of the works is permitted provided that this instrument is retained", 80, 1.0),
    ("blessing", "may you do good and not evil", 70, 0.8),
    ("json", "the software shall be used for good not evil", 84, 1.0),
    ("vim", "vim is charityware", 80, 1.0),
    ("x11", "shall not be used in advertising or otherwise to promote the sale", 82, 0.8),
    # redistribution clauses
    ("bsd", "redistribution and use in source and binary forms", 78, 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice", 70, 0.8),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 70, 0.8),
    ("bsd-3-clause", "neither the names? of (?:[^ ]+ ){1,40}?may be used to endorse", 80, 1.0),
    ("bsd-3-clause", "the names? of (?:the )?(?:author|authors|copyright holders?|contributors) may not be "
     "used to endorse or promote products", 80, 0.9),
    ("bsd-3-clause-clear", "no express or implied licen[cs]es to any party s patent rights are granted", 82, 1.0),
    ("bsd-4-clause", "all advertising materials mentioning features", 80, 1.0),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include", 80, 0.9),
    ("php-3", "this product includes php software freely available from", 82, 0.9),
    ("openssl", "this product includes software developed by the openssl project", 82, 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty in no event", 75, 0.9),
    ("zlib", "the origin of this software must not be misrepresented", 78, 0.9),
    ("zlib", "altered source versions must be plainly marked as such", 78, 0.9),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy",
     82, 1.0),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied",
     80, 1.0),
    ("artistic-2", "this licen[cs]e establishes the terms under which a given free software package may be copied", 80, 0.9),
    # patent and notice clauses
    ("apache-2", "you may not use this file except in compliance with the licen[cs]e", 75, 0.9),
    ("apache-2", "terms and conditions for use reproduction and distribution", 72, 0.8),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge", 74, 0.9),
    ("apache-2", "licen[cs]ed to the apache software foundation asf under one", 76, 0.9),
    ("apache-2", "must give any other recipients of the work or derivative works a copy of this licen[cs]e", 74, 0.9),
    ("ecl-2", "educational community licen[cs]e", 78, 0.9),
    ("ms-pl", "microsoft public licen[cs]e", 78, 0.9),
    ("ms-pl", "if you use the software you accept this licen[cs]e if you do not accept the licen[cs]e", 72, 0.7),
    ("ms-rl", "microsoft reciprocal licen[cs]e", 78, 0.9),
    ("upl-1", "universal permissive licen[cs]e", 78, 0.9),
    ("afl-3", "academic free licen[cs]e", 78, 0.9),
    ("osl-3", "open software licen[cs]e", 78, 0.9),
    ("mulan-2", "mulan permissive software licen[cs]e", 78, 0.9),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without "
     "restriction", 80, 0.9),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and licen[cs]e this software", 80, 0.9),
    ("w3c", "w3c software (?:and document )?notice and licen[cs]e", 80, 0.9),
    # copyleft
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu", 75, 0.9),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e", 74, 0.9),
    ("gpl", "this program comes with absolutely no warranty", 60, 0.6),
    ("gpl", "the licen[cs]es for most software are designed to take away your freedom", 80, 0.9),
    ("gpl-2", "we protect your rights with two steps 1 copyright the software", 80, 0.8),
    ("gpl-3", "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works",
     82, 1.0),
    ("gpl-classpath", "linking this library statically or dynamically with other modules is making a combined work",
     84, 1.0),
    ("gpl-font", "if you create a document which uses this font and embed this font", 84, 0.9),
    ("gpl-runtime", "gcc runtime library exception", 84, 0.9),
    ("gpl-bison", "as a special exception you may create a larger work that contains part or all of the bison "
     "parser skeleton", 84, 1.0),
    ("gpl-autoconf", "as a special exception the (?:free software foundation|respective autoconf macro s "
     "copyright owner) gives unlimited permission", 84, 0.9),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", 76, 0.9),
    ("lgpl", "a program that contains no derivative of any portion of the library", 80, 0.9),
    ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e", 76, 0.9),
    ("agpl-3", "your modified version must prominently offer all users interacting with it remotely", 82, 1.0),
    ("gfdl", "gnu free documentation licen[cs]e", 78, 0.9),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu",
     80, 0.9),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 80, 1.0),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[cs]e", 78, 0.95),
    ("mpl-2", "this source code form is incompatible with secondary licen[cs]es", 80, 0.9),
    ("epl-1", "the accompanying program is provided under the terms of this eclipse public licen[cs]e", 76, 0.9),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse "
     "public licen[cs]e 2 0", 82, 1.0),
    ("cpl-1", "common public licen[cs]e", 76, 0.9),
    ("ipl-1", "ibm public licen[cs]e", 76, 0.9),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution",
     80, 0.9),
    ("npl", "netscape public licen[cs]e", 78, 0.9),
    ("eupl-1.2", "licen[cs]ed under the eupl", 70, 0.8),
    ("cecill", "ce logiciel est r.{1,4}gi par la licence cecill|governed by the cecill licen[cs]e", 78, 0.9),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete "
     "source code", 82, 0.9),
    ("qpl", "the q public licen[cs]e", 78, 0.9),
    ("sspl-1", "server side public licen[cs]e", 78, 0.9),
    ("copyleft-other", "copyleft licen[cs]e", 30, 0.5),
    # public domain and content
    ("unlicense", "free and unencumbered software released into the public domain", 80, 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 80, 1.0),
    ("public-domain", "(?:dedicated to|released into|placed in) the public domain", 60, 0.8),
    ("public-domain", "this (?:file|work|software|code) is in the public domain", 60, 0.8),
    ("cc0-1", "to the extent possible under law (?:[^ ]+ ){1,30}?waived all copyright", 80, 1.0),
    ("cc0-1", "the person who associated a work with this deed has dedicated the work", 80, 0.9),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", 80, 1.0),
    ("cc-by", "you must give appropriate credit provide a link to the licen[cs]e", 66, 0.7),
    ("cc-by-sa", "you must distribute your contributions under the same licen[cs]e as the original", 70, 0.8),
    ("cc-by-nc", "you may not use the material for commercial purposes", 70, 0.8),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material",
     70, 0.8),
    ("ofl-1.1", "this font software is licen[cs]ed under the sil open font", 80, 1.0),
    ("ofl-1.1", "the font software may not be sold by itself|no modified version of the font software may use the "
     "reserved font name", 80, 0.8),
    ("odbl", "this (?:database|data) is made available under the open database licen[cs]e", 80, 1.0),
    ("ogl-3", "open government licen[cs]e", 78, 0.9),
    # source available and closed
    ("bsl-1.1", "business source licen[cs]e", 78, 0.9),
    ("bsl-1.1", "the licen[cs]or hereby grants you the right to copy modify create derivative works redistribute "
     "and make non production use", 82, 1.0),
    ("elastic-2", "elastic licen[cs]e", 74, 0.8),
    ("commons-clause", "commons clause", 76, 0.8),
    ("polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict)", 78, 0.9),
    ("evaluation", "for evaluation purposes only", 50, 0.7),
    ("non-commercial", "for (?:personal and )?non ?commercial use only", 55, 0.8),
    ("research-only", "for (?:academic|research|educational) (?:use|purposes) only", 55, 0.8),
    ("proprietary", "all rights reserved", 30, 0.6),
    ("proprietary", "proprietary and confidential|confidential and proprietary", 60, 0.9),
    ("proprietary", "(?:do not|may not be) (?:copied|reproduced|distribute|redistributed)"
     "(?: [a-z]+){0,4} without", 60, 0.8),
    ("proprietary", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,8} is strictly prohibited",
     60, 0.9),
    ("proprietary", "this software is the (?:confidential|proprietary)(?: and [a-z]+)? (?:information|property) of",
     60, 0.9),
    ("proprietary", "by (?:installing|downloading|using) (?:this|the) software you agree to be bound", 55, 0.8),
    ("proprietary", "you may not reverse engineer decompile or disassemble", 55, 0.8),
    ("see-license", "see (?:the )?licen[cs]e(?: file)? for", 25, 0.4),
    ("see-license", "use of this source code is governed by (?:a|an) (?:[^ ]+ ){1,6}?licen[cs]e that can be found",
     45, 0.6),
]

#: What a keyword cannot come from: groups, classes and optional characters of a pattern.
_NOT_LITERAL = re.compile(r"\(\?:[^()]*\)\??|\((?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\]|[^ ]?\{[^}]*\}\??|.\?|\.")


class Rule(NamedTuple):
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    confidence: float


def keyword_of(pattern: str) -> bytes:
    """The longest run of characters that every match of a pattern of words holds.

    A pattern with branches outside of groups has no such run: its keyword is empty and in every text.
    """
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return b""
    runs = _NOT_LITERAL.sub("\0", pattern).split("\0")
    return max((run.strip() for run in runs), key=len).encode()


def default_rules() -> list[Rule]:
    """Every name in every use, and the sentences: some hundreds, highest priority first.

    Longer names go first within a priority, since the version of a family says more.
    """
    found = []
    for label, names in FAMILIES:
        found += [(label, keyword_of(name), use.format(f"(?:{name})"), priority, confidence)
                  for name in names for use, priority, confidence in USES]
    # the branches of a sentence are rules of their own, so that each has its keyword
    found += [(label, keyword_of(branch), branch, priority, confidence)
              for label, sentence, priority, confidence in SENTENCES for branch in _branches(sentence)]
    rules = [Rule(label, keyword, re.compile(rf"(?<![^ ])(?:{p})(?![^ ])".encode()), priority, confidence)
             for label, keyword, p, priority, confidence in found]
    return sorted(rules, key=lambda r: (-r.priority, -len(r.pattern.pattern)))


def _branches(pattern: str) -> list[str]:
    """A pattern cut at the bars outside of its groups."""
    return re.split(r"\|(?![^()]*\))", pattern)


#: Words are runs of a-z, 0-9 and anything beyond ASCII, after A-Z are lowered.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Detection(NamedTuple):
    label: str
    start: int
    end: int
    priority: int
    confidence: float


def _outline(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans that no other contains; both grow."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not ends or end > ends[-1]:
            starts.append(start)
            ends.append(end)
    return starts, ends


def detect(joined: bytes, rules: list[Rule]) -> list[Detection]:
    """Detections that no other of higher priority contains; equal ones keep the first rule's.

    Matches of one rule do not overlap, so each is looked up by its start in the outline of the rules
    before, which is merged once a rule: the work grows with the matches, not with their pairs.
    """
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    held: dict[bytes, bool] = {}
    for rule in rules:
        if rule.keyword not in held:
            held[rule.keyword] = rule.keyword in joined
        if not held[rule.keyword]:
            continue
        new = []
        for m in rule.pattern.finditer(joined):
            before = bisect_right(starts, m.start()) - 1
            if before < 0 or ends[before] < m.end():
                new.append(m.span())
        if new:
            kept += [Detection(rule.label, a, b, rule.priority, rule.confidence) for a, b in new]
            starts, ends = _outline([*zip(starts, ends, strict=True), *new])
    return sorted(kept, key=lambda d: (d.start, d.end))


def word_numbers(joined: bytes, places: list[int]) -> list[int]:
    """Blanks before each place, from one pass over the text."""
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.searchsorted(blanks, places).tolist()


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """Word numbers at which a base phrase starts, with its label; phrases may overlap."""
    found = []
    for phrase, label in BASE_PHRASES:
        p = phrase.encode()
        at = joined.find(p)
        while at >= 0:
            end = at + len(p)
            if (at == 0 or joined[at - 1] == 32) and (end == len(joined) or joined[end] == 32):
                found.append((at, label))
            at = joined.find(p, at + 1)
    if not found:
        return []
    numbers = word_numbers(joined, [at for at, _ in found])
    return sorted(zip(numbers, [label for _, label in found], strict=True))


SCHEMA = ("id {}, n_words long, base array<struct<word: long, label: string>>, "
          "detections array<struct<label: string, first_word: long, end_word: long, "
          "priority: int, confidence: double>>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, base, detections``, over whole texts.

    ``base`` are the places of the base phrases, ``detections`` the rules' (words from 0, end
    exclusive). Null and empty texts have no words and no detection; equal rows give equal results;
    an empty table an empty result. A row is worked on alone, so no key gathers rows.
    """
    own = rules if rules is not None else default_rules()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                joined = b" ".join(words)
                found = detect(joined, own)
                first = word_numbers(joined, [d.start for d in found]) if found else []
                last = word_numbers(joined, [d.end for d in found]) if found else []
                hits = [(d.label, a, b + 1, d.priority, d.confidence)
                        for d, a, b in zip(found, first, last, strict=True)]
                out.append((len(words), base_places(joined), hits))
            yield pd.DataFrame({
                "id": batch["id"], "n_words": [x[0] for x in out],
                "base": [[{"word": w, "label": label} for w, label in x[1]] for x in out],
                "detections": [[dict(zip(("label", "first_word", "end_word", "priority", "confidence"), h,
                                         strict=True)) for h in x[2]] for x in out]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        scan, SCHEMA.format(kind))


def license_digest(scanned: DataFrame) -> DataFrame:
    """Columns of the query from the scan's."""
    places = F.transform("base", lambda b: b["word"])
    labels = F.transform("base", lambda b: b["label"])
    return scanned.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(labels))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(
            labels, F.transform("detections", lambda d: d["label"]))))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])),
                   F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"))
