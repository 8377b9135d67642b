"""URL filter, licence and secret scans and page text against plain Python."""

import hashlib
import re

from pairflow.llm import html_text, licenses, secrets, url_filter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
URLS = [
    "http://a.example.com/en/1?x=/es/", "https://www.example.com/en/", "https://m.www.example.com/en/1", "http://example.com", "x://com/",
    "http://example.net/es/1#a", "http://NET/fr/", "http://net/fr", "http://spam.org/", "http://a.Spam.org?q", "http://notspam.org/",
    "http://example.com.net/en/", "no scheme", "", None, "http://", "a://b://c/en/", "http://x.net?/es/", "http://com:80/", "ftp://e.com#/"]


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    blocked = host == "spam.org" or host.endswith(".spam.org")
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if blocked else "allow"


def test_url_filter(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "x"), (0, URLS[0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((tuple(r) for r in url_filter.judge(pages, RULES, ["spam.org"]).collect()), key=str)
    assert got == sorted(((i, *judged(u)) for i, u, _ in rows), key=str)
    assert url_filter.judge(pages.limit(0), RULES, ["spam.org"]).collect() == []


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter.bloom, "bits_for", lambda n, per_key=1:  # many false positives, so many levels
                         max(64, 1 << (4 * n - 1).bit_length()))
    universe, listed = [f"k{i}" for i in range(4000)], [f"k{i}" for i in range(0, 4000, 7)]
    table = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_filter.build(table(universe), table(listed))
    assert len(cascade.levels) > 3
    rows = table(universe).select("key", url_filter.F.array("key").alias("own"))
    got = {r.key for r in url_filter._with_first(rows, "own", cascade, "at").filter("at = 0").collect()}
    assert got == set(listed)


def words_of(text):
    return [(m.start(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]


def base(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for _, w in words_of(text)]
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({label for _, label in places})))


LICENSED = [
    "Released under the MIT License.", "MIT-license mit\nLICENSE, submit license mit licensed", "The Apache License, Version 2.0 and mit license",
    "GNU Lesser General Public License, version 2.1", "general  public -- license General Public License, version 3",
    "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under CC BY-NC 4.0.", "émit license mité license mit 1license", "no such thing",
    "see http://www.apache.org/licenses/LICENSE-2.0", "bsd-3-clause or Mozilla Public License 2.0"]


def test_license_base_and_labels(spark, odd_docs, odd_rows, empty_docs):
    docs = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(LICENSED):
        assert tuple(got[i])[1:6] == base(text), text
    assert got[0].labels == "mit" and got[2].labels == "apache,apache-2.0,mit" and got[3].labels == "gpl,lgpl-2.1"
    assert got[5].labels == "gpl-3.0" and got[5].score == 1.0 and got[6].labels == "cc-by-nc-4.0"
    assert got[8].labels == "" and got[8].score == 0.0
    assert "apache-2.0" in got[9].labels and got[10].labels == "bsd-3-clause,mpl-2.0"
    odd = sorted((tuple(r)[:6] for r in licenses.scan(odd_docs).collect()), key=str)
    assert odd == sorted(((r[0], *base(r[1])) for r in odd_rows), key=str)
    assert licenses.scan(empty_docs).collect() == []


def test_license_gates_hold_every_name():
    scanner = licenses.Scanner()
    assert len(scanner.rules) > 200
    names = ["gnu affero general public license v3", "lgpl-2.1", "mozilla public license 2.0", "the unlicense", "cc0", "wtfpl",
             "zlib/libpng license", "openrail-m license", "european union public licence", "python software foundation license",
             "do what the fuck you want to public license", "all rights reserved", "cecill-b", "x11 license", "llama 3 community license",
             "simplified bsd license", "freebsd license", "odbl", "pddl", "ms-pl", "0bsd", "expat license", "mit-0"]
    for text in names:
        gated = scanner.detections(text)
        every = {}
        for i in range(len(scanner.rules)):
            every.setdefault("", set()).add(i)
        whole = licenses.Scanner()
        whole.automaton = type("All", (), {"iter": lambda self, _: [(0, every[""])]})()
        assert gated and gated == whole.detections(text), text


MIT = """Copyright (c) 2020 A. All rights reserved.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY"""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
BSD = """Copyright (c) 1990 B. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
(b) Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. """
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"""
UNNAMED = [
    (MIT + ", subject to the following conditions: " + MIT_END, "mit"), (MIT + ". The software is provided as is", "mit-0"), (MIT_END, "mit"), (MIT_END + " " + BSD_END, "bsd,mit"),
    (ISC + ", provided that the above copyright notice appears", "isc"), (ISC + ". The software is provided as is", "0bsd"),
    (BSD + BSD_END, "bsd-2-clause"), (BSD + "3. Neither the name of B nor the names of its contributors may be used. " + BSD_END, "bsd-3-clause"),
    (BSD + "3. All advertising materials mentioning features or use of this software must display this. " + BSD_END, "bsd-4-clause"),
    (BSD_END, "bsd"), ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted. All rights reserved.", "bsd"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("All rights reserved.", "proprietary"),
    (BSD + BSD_END + " Proprietary and confidential.", "bsd-2-clause,proprietary"), ("The permission is granted hereby; redistribution is not.", "")]


def test_license_wording_without_names(spark):
    marked = lambda text: "/*\n * " + text.replace("\n", "\n * ") + "\n */"
    rows = [(i, f(t)) for i, t in enumerate(t for t, _ in UNNAMED) for f in (str, marked)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.labels == UNNAMED[r.doc_id][1], (r.doc_id, r.labels)


PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


KEY, HEX = "AKIA" + "ABCDEFGHIJ234567", "0123456789abcdef01234567"
SECRET_TEXTS = [
    "password=abcdef12 TOKEN: 'xyz123' api_key = \"short\" apikey:abcdefg", f"🙂é {KEY} and {HEX}{HEX} token=\"{HEX}\"",
    "secret:token:abcdef", "secret = token = abcdefgh", "AKIAshort AKIA" + "A" * 15, "a" * 23 + " " + "b" * 24, "password:==a=b=c", "",
    None, "passwd='" + "x" * 5 + "' api__key=abcdefgh", "İpassword=ſecret12 \x00token=abc.def", "-----BEGIN RSA PRIVATE KEY-----\nabcd\n-----END RSA PRIVATE KEY-----",
    "key Ab3" + "Qz9x" * 9 + " end", f"token={HEX}token={HEX}"]


def test_secret_spans(spark):
    rows = [(i, t, f"src{i}") for i, t in enumerate(SECRET_TEXTS)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text in enumerate(SECRET_TEXTS):
        spans = base_spans(text)
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in PATTERNS] == spans, text
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
    assert "pem:0:" in got[11].spans and "entropy:4:" in got[12].spans


def test_ownership_tells_copies_from_live(spark, odd_docs, odd_rows, empty_docs):
    rows = [(i, f"n{i} token={HEX}", f"src{i % 4}") for i in range(20)] + [(50, f"x {KEY} y", "src1"), (51, "password=hunter22 z", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[3].n_live == 0 and got[3].n_copied == 2 and got[50].n_live == 1 and got[51].n_live == 1
    texts = {r.doc_id: r.text for r in secrets.masked(docs).collect()}
    assert texts[3] == rows[3][1] and texts[50] == "x <secret> y" and texts[51] == "<secret> z"
    assert secrets.scan(empty_docs).collect() == [] and secrets.masked(empty_docs).collect() == []
    assert secrets.scan(odd_docs).count() == len(odd_rows)
    kept = secrets.masked(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(odd_rows, key=str)


def test_live_values_look_random_and_are_specific(spark):
    values = {"required": 0, "function": 0, "getAccessToken": 0, "aaaaaaaaaaaa1": 0, "2026-12-01": 0, "hunter22": 1, "kQzXvWpTbRmL": 1,
              "xkqjzvwpfh": 1, "84736251": 1, HEX: 1, "0" * 32: 0}
    rows = [(i, f"password: {v} end", "a") for i, v in enumerate(values)]
    rows += [(100 + i, f"row {i} api_key=q7Zp0Xw3Lk9V", "hot") for i in range(40)]
    rows += [(200 + i, "token=n0wn3rT0k3n", None) for i in range(2)] + [(300, "token=al0neT0k3nX", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for i, (v, live) in enumerate(values.items()):
        assert (got[i].n_live > 0) == bool(live) and got[i].n_live + got[i].n_copied > 0, v
    assert all(got[100 + i].n_live == 1 for i in range(40))
    assert got[200].n_live == got[201].n_live == 0 and got[300].n_live == 1
    texts = {r.doc_id: r.text for r in secrets.masked(docs).collect()}
    assert texts[0] == rows[0][1] and texts[139] == "row 39 <secret>" and texts[200] == "token=n0wn3rT0k3n"


def test_long_keys_and_key_headers(spark):
    body = "".join(hashlib.sha256(str(i).encode()).hexdigest() + "Qz\n" for i in range(3000))
    block = lambda head, text, kind="RSA ": f"-----BEGIN {kind}PRIVATE KEY-----\n{head}{text}-----END {kind}PRIVATE KEY-----"
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD0123ABCD\n\n"
    run = body.replace("\n", "")
    whole = {block("", body[:8041]): "pem", block("", body): "pem", block(headers, body[:670]): "pem", block(headers, body): "pem",
             block("", body[:670].replace("\n", "\\n")): "pem", block("", body[:670], "ENCRYPTED "): "pem",
             run[:200]: "entropy", run[:201]: "entropy", run: "entropy"}
    broken = ["-----BEGIN RSA PRIVATE KEY-----\n" * 5000, ("-----BEGIN RSA PRIVATE KEY-----\n" + "a-b: c\n" * 20000), "A-" * 100_000]
    rows = [(i, f"x {t} y", f"s{i}") for i, t in enumerate([*whole, *broken])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.spans.split(",") for r in secrets.scan(docs).collect()}
    texts = {r.doc_id: r.text for r in secrets.masked(docs).collect()}
    for i, (text, kind) in enumerate(whole.items()):
        assert f"{kind}:2:{2 + len(text)}" in got[i] and texts[i] == "x <secret> y", (i, kind)
    assert all("pem" not in s and "entropy" not in s for i in range(len(whole), len(rows)) for s in got[i])


def test_few_of_very_many_owners(spark):
    candidates = spark.createDataFrame([(o, 1, v, True) for v, n in ((1, 3), (2, 4)) for o in map(str, range(n))],
                                       "owner string, repository long, value long, random boolean")
    live = lambda n: {r.value: r.live for r in secrets.ownership(candidates, spark.createDataFrame([(n,)], "n_all long")).collect()}
    assert live(3000) == {1: True, 2: False} and live(2999) == {1: False, 2: False}


def test_secret_scan_is_native(spark, odd_docs):
    plan = secrets.scan(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ARTICLE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>"
           "<header>Site name, the best.</header><nav><ul><li><a href=x>Home<li><a>News</a></ul></nav>{before}{open}<h1>Head &amp; line</h1>"
           "<p>First paragraph, with <b>bold</b>\n text;&nbsp;and more of it, quite long. <p>Short.<br>Next<!-- no --><script>x('<p>')</script>"
           "<ul><li>One item, long enough.<li>Two</ul><p>The last paragraph of the article has words, and marks too.{close}{after}"
           "<aside>See also this, and that.</aside><form>Your mail: <input><button>Go</button></form>"
           "<div class='comments'><p>I do not agree, and here is why: a long comment of a reader, with many words and marks.</p></div>"
           "<div id=\"cookie-notice\">We use cookies, always.</div><footer>&copy; 2020, all of us.</footer></body></html>")
WANTED = ("Head & line\nFirst paragraph, with bold text; and more of it, quite long.\nShort. Next\nOne item, long enough.\nTwo\n"
          "The last paragraph of the article has words, and marks too.")


def page(open_, close, before="", after=""):
    return ARTICLE.replace("{open}", open_).replace("{close}", close).replace("{before}", before).replace("{after}", after)


def test_main_text():
    assert html_text.main_text(page("<article>", "</article>")) == WANTED
    assert html_text.main_text(page("<main>", "</main>", '<div class="ad">Buy now, buy here.</div>')) == WANTED
    assert html_text.main_text(page('<div class="content">', "</div>")) == WANTED
    assert html_text.main_text(page('<div class="main no-sidebar ad-free"><article class="post">', "</article>", "",
                                    '<section><article class="comment">I think, that this is long and wrong, and more.</article></section></div>')) == WANTED
    cut = page("<article>", "</article>")
    assert html_text.main_text(cut[:cut.index("The last")] + "The end &am").endswith("\nThe end &am")
    assert html_text.main_text("<p>Only text</p>") == "Only text"
    assert html_text.main_text("plain words &lt;b&gt;") == "plain words <b>"
    assert html_text.main_text("<nav>menu</nav>") == "" and html_text.main_text("") == ""


def test_content_outside_the_largest_element_stays():
    lead, end = "The lead says, in short, what is to come: much, and more of it.", "The closing paragraph, set apart, sums up: all is said, and well."
    body = "".join(f"<p>Paragraph {i}, of the body, is long: it has words, marks, and more words than the others have.</p>" for i in range(60))
    texts = [f"Paragraph {i}, of the body, is long: it has words, marks, and more words than the others have." for i in range(60)]
    wanted = "\n".join(["Headline", lead, *texts, end])
    nav, foot = "<nav><a>Home</a></nav>", "<div class=ad>Buy now, buy here.</div><footer>All of us, 2020.</footer>"
    for top, bottom in (("<div class=content>", "</div>"), ("", "")):
        got = html_text.main_text(f"<body>{nav}{top}<h1>Headline</h1><div class=lead><p>{lead}</p></div><div class=body>{body}</div>"
                                  f"<div class=end><p>{end}</p></div>{bottom}{foot}</body>")
        assert got == wanted
    long = f"<div class=content><h1>Headline</h1><div class=lead><p>{lead}</p></div><div class=body>{'Long, and long again. ' * 200}</div></div>"
    assert html_text.main_text(f"<body>{nav}{long}{foot}</body>").split("\n")[:2] == ["Headline", lead]
    half = f"<body>{nav}<article>{body}</article><div class=more>{body.replace('Paragraph', 'Part')}</div>{foot}</body>"
    assert html_text.main_text(half).split("\n") == texts + [t.replace("Paragraph", "Part") for t in texts]
    inner = f"<article><h2>Head</h2><div class=body>{body}</div><ul><li>End</ul></article><div><span>Below</span></div>"
    assert html_text.main_text(f"<body>{nav}{inner}{foot}</body>") == "\n".join(["Head", *texts, "End"])


def test_page_rows(spark):
    rows = [(1, "u", page("<article>", "</article>"), "x"), (1, "u", page("<article>", "</article>"), "x"), (2, None, None, "x"),
            (None, "v", "", "x"), (3, "w", "<article><p>" + "word " * 200_000 + "</article>", "x"), (4, "z", "<div" * 5000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str)
    long_text = " ".join(["word"] * 200_000)
    want = [(1, "u", WANTED, len(WANTED))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", long_text, len(long_text)), (4, "z", "", 0)]
    assert got == sorted(want, key=str)
    assert html_text.extract(pages.limit(0)).collect() == []
