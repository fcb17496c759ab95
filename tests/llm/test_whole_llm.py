"""The training-data operators on cases that they once left out."""

from collections import Counter
from urllib.parse import urljoin

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marketlens.llm import license_scan, quality_rules, range_coder, url_filter

MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
'''
APACHE = '''# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
'''
GPL = '''/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
'''
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"
AROUND = " ".join(f"word{k}" for k in range(37))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (MIT, {"MIT-grant"}), (MIT.replace('"Software"', "\u201cSoftware\u201d"), {"MIT-grant"}), (APACHE, {"Apache-2.0", "Apache-2.0-text"}), (GPL, {"GPL-text"}),
        (GPL.replace("GNU", "GNU Affero"), set()), (BSD, {"BSD-text"}), ("Released under the MIT License and shared.", {"MIT"}), ("(licensed under CC BY-NC 4.0, see below)", {"CC-BY-NC-4.0"}),
        ("Licensed under the Apache License, Version 2.0 (the file)", {"Apache-2.0"}), ("This work is licensed under the GNU General Public License, version 3, or later", {"GPL-3.0"}), ("# . / * - - -", set()),
    ],
)
def test_standard_licenses_in_running_text(text, expected):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for before in ("", AROUND + "\n", AROUND + " * "):
        whole = before + text + "\n" + AROUND
        got = scanner.matches(whole)
        assert Counter(m[0] for m in got) == Counter(expected)
        words = whole.split()
        for _, first, end, _ in got:
            assert 0 <= first < end <= len(words)
    at = scanner.matches("* * released ** under the MIT License. *")
    assert at == [("MIT", 2, 8, 1.0)]


def test_relative_targets(spark):
    bases = ["http://a.org", "http://a.org/", "https://a.org/x/y/z.html?q=1#f", "http://a.org/x/y/"]
    targets = ["index.html", "./b", "../en/a", "../../../c", "..", ".", "d/../e/./f", "?p=2", "/g/../h", "//b.org/i", "http://c.org/k?u=../v", "?u=http://d.org/", "l?m=/../n", "o/..", "p/"]
    rows = spark.createDataFrame([(b, t) for b in bases for t in targets], "base string, target string")
    for b, t, got in rows.select("base", "target", url_filter.resolve(F.col("target"), F.col("base"))).collect():
        assert got.split("://")[1].replace("org?", "org/?") == urljoin(b, t).split("://")[1].replace("org?", "org/?"), (b, t)
    whole = rows.limit(1).select(url_filter.resolve(F.lit("http://c.org/j/../k?u=../v"), F.col("base"))).first()[0]
    assert whole == "http://c.org/k?u=../v"  # urljoin leaves whole addresses as they are


def test_blocks_follow_every_relative_link(spark):
    rules = [url_filter.Rule("block", "bad.org", "/en/")]
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://bad.org/de/a", link.format("../en/a")), (2, "http://bad.org/", refresh.format("en/b")), (3, "http://bad.org/de/", link.format("c.html")), (4, "http://ok.org/p", link.format("?p=2")),
        (5, "http://ok.org/q", link.format("http://ok.org/r") + link.format("http://bad.org/en/c")), (6, "http://ok.org/s", refresh.format("t") + refresh.format("//bad.org/en/d")), (7, "http://ok.org/t", ""),
        (8, "http://ok.org/p?p=2", refresh.format("http://bad.org/en/e")), (9, "http://ok.org/u", '<base href="http://bad.org/en/x/">' + link.format("../f")), (10, "http://ok.org/v", link.format("mailto:a@bad.org")),
        (11, "http://ok.org/w", link.format("#bad.org/en/")), (12, "http://ok.org/r", None), (13, None, link.format("en/b")),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    blocked = {1, 2, 4, 5, 6, 7, 8, 9, 12}
    assert got == {k: "block" if k in blocked else "allow" for k in range(1, 14)}


def test_unlabelled_documents_are_compared(spark):
    english = ["the stone of the river and a letter to the garden in winter, that is music for it"] * 30
    spanish = ["el jardin de la casa que y en los rios a las piedras se"] * 30
    rows = [(k, t + f" {chr(97 + k)}", lang) for texts, lang in ((english, "en"), (spanish, "es")) for k, t in enumerate(texts[:20])]
    junk = " ".join(f"{'#$%|<>@~' * 3}{k}{'^=+{}' * 3}" for k in range(60))
    clean = " ".join(f"stone river{chr(97 + k % 26)} garden, cloudy{chr(97 + k // 26)} morning" for k in range(60))
    rows += [(100, junk, None), (101, junk, "xx"), (102, clean, None), (103, "# $ %", None), (104, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.measure(docs).where("doc_id >= 100").collect()}
    for k in (100, 101):
        assert not got[k]["base_failed"] and not got[k]["kept"] and got[k]["char_distance"] > quality_rules.Limits().char_distance and got[k]["word_distance"] is None
    assert got[102]["kept"] and got[102]["char_distance"] is not None
    assert got[103]["char_distance"] is None and got[104]["char_distance"] is None


def test_large_ids_are_an_error(spark):
    docs = spark.createDataFrame([(1, "river")], "doc_id long, text string")
    files = range_coder.write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end=65_535)
    assert np.frombuffer(range_coder.read_files(files).first()["ids"], "<u4")[-1] == 65_535
    for ids in ([65_536], [1, 70_000, 2]):
        with pytest.raises(ValueError):
            range_coder.narrowed(np.array(ids, "<u4"))
