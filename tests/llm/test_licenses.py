import re

from pixelloom.llm import licenses

from .helpers import SCHEMA, awkward


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(rows):
    out = []
    for r in rows:
        w, places, labels = words_of(r[1]), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out.append((r[0], len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(out, key=str)


def test_base_equals_brute_force(spark):
    text = "Released UNDER the\nMIT-License; apache license, Version 2.0 (CC BY-NC) under the mıt license under the mit license"
    rows = awkward() + [(900, text, None, None, 0, None, None), (901, "cc by nc", None, None, 0, None, None)]
    rows += [(902, "K under the mİt license K under the MIT license", None, None, 0, None, None)]
    got = licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    cut = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(cut, key=str) == brute(rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_templates_are_found_with_small_changes(spark):
    rows = []
    for i, (label, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        rows.append((i, "Intro words here. " + text.upper() + " and more", None, None, 0, None, None))
        changed = w[: len(w) // 2] + ["inserted"] + w[len(w) // 2 :]
        rows.append((100 + i, " ".join(changed), None, None, 0, None, None))
        rows.append((200 + i, " ".join(w[: len(w) // 3]), None, None, 0, None, None))
    found = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, label in enumerate(licenses.TEMPLATES):
        assert label in found[i].labels.split(",")
        assert label in found[100 + i].labels.split(",")
        assert label not in found[200 + i].labels.split(",") or label in found[200 + i].base_labels.split(",")


def test_notices_without_a_phrase_get_labels_and_families_are_told_apart(spark):
    notices = [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-notice"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
        ("We like general public events, and work under a license.", ""),
    ]
    rows = [(i, f"Some words before.\n{t}\nAnd some words behind.", None, None, 0, None, None) for i, (t, _) in enumerate(notices)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[i].labels, got[i].base_labels) for i in range(len(notices))] == [(label, "") for _, label in notices]


def test_empty(spark):
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
