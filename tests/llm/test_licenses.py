"""License scan: base places against a loop, rules on texts that say their license."""

import re
import time

from halflight.llm import licenses

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), sorted(found)


def test_query_against_brute_force(spark):
    from halflight.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_license_scan"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, found = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        said = texts[r.doc_id] or ""
        if "GNU General Public License, version 3" in said:
            assert "gpl-3" in r.labels.split(",") and "gpl" not in r.labels.split(",")
    assert any(r.n_base for r in got)


def test_rules(spark):
    assert len(licenses.default_rules()) >= 200
    cases = {"Licensed under the GNU Lesser General Public License v2.1": "lgpl-2.1",
             "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
             "SPDX-License-Identifier: GPL-3.0": "gpl-3", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "released under the 3-clause BSD license": "bsd-3-clause", "All rights reserved.": "proprietary",
             "Mozilla Public License 2.0": "mpl-2", "is a license to print money": "", "": "",
             "commit license": "", "under the MIT License, and again under the MIT License": "mit"}
    rows = [(n, t) for n, t in enumerate(cases)] + [(99, None), (98, "é word " * 50000 + "cc by nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base", "2 as id")
    got = {r.doc_id: r for r in licenses.license_digest(licenses.scan_licenses(docs)).collect()}
    assert {t: got[n].labels for n, t in enumerate(cases)} == cases
    assert got[10].n_base == 2 and (got[10].first_word, got[10].last_word) == (0, 6)
    assert got[99].n_words == 0 and got[99].score == 0.0
    assert got[98].first_word == 100000 and got[98].labels == "cc-by-nc"
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def plain(joined, rules):
    kept = []
    for rule in rules:
        for m in rule.pattern.finditer(joined):
            if not any(k.start <= m.start() and m.end() <= k.end for k in kept):
                kept.append(licenses.Detection(rule.label, m.start(), m.end(), rule.priority, rule.confidence))
    return sorted(kept, key=lambda d: (d.start, d.end))


NOTICES = (
    "Licensed under the Apache License, Version 2.0. All rights reserved. GNU General Public License, version 3 "
    "or later, see LICENSE for more. Neither the name of the Institute of Very Long and Winding Names and of its "
    "many friends in all the countries of the world nor the names of its contributors may be used to endorse "
    "products. CC BY-NC-SA 4.0, under the MIT license, cc by nc. ")


def test_detections_are_those_of_all_pairs_and_keywords_lose_none():
    rules = licenses.default_rules()
    assert all(r.keyword for r in rules)
    joined = b" ".join(licenses.words_of(NOTICES * 10))
    got = licenses.detect(joined, rules)
    assert got == plain(joined, rules)
    assert {"apache-2", "gpl-3", "bsd-3-clause", "cc-by-nc-sa", "mit", "see-license"} <= {d.label for d in got}
    spoken = [s for s in licenses.SENTENCES if re.fullmatch("[a-z0-9 ]+", s[1].replace("licen[cs]e", ""))]
    assert len(spoken) > 60
    for label, sentence, *_ in spoken:
        said = sentence.replace("licen[cs]e", "license").encode()
        assert licenses.detect(said, rules), label
    assert [d.label for d in licenses.detect(
        b"neither the name of acme nor the names of its contributors may be used to endorse", rules)] == [
        "bsd-3-clause"]


def test_a_megabyte_of_notices():
    rules, joined = licenses.default_rules(), b" ".join(licenses.words_of(NOTICES * 2800))
    assert len(joined) > 1_000_000
    start = time.process_time()
    found = licenses.detect(joined, rules)
    numbers = licenses.word_numbers(joined, [d.start for d in found])
    assert time.process_time() - start < 8  # about 2 s
    assert len(numbers) == len(found) > 10_000 and licenses.base_places(joined)[-1][0] > 100_000
    assert numbers[-1] == joined.count(b" ", 0, found[-1].start)
