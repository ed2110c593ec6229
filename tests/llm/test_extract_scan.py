import hashlib
import html
import itertools
import random
import re

import pytest

from sieveline.llm import html_extract, license_scan, pii

PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site no</h1><p>Tagline no, which is a long one here.</p></header>
<div id="cookie-notice"><p>We no use cookies to improve the experience you have here.</p></div>
<nav><ul><li><a href=a>no home</a><li><a href=b>no about</a></ul></nav><!-- no <p>comment</p> -->
<div class="wrap"><div class="sidebar"><h3>no Related</h3><ul><li><a href=x>no thing</a></ul></div>
<article><header><h1>Title   here</h1></header><p><b>First &amp; <a href=z>linked</a>&nbsp;paragraph is long,
 and tells a story.<br><p>Short.</p><div class="ad">no Buy</div><ul><li>item one<li>item <i>two</i></ul>
<table><tr><td>a<td>b</table><form><label>no Name</label><button>no Go</button></form>
<aside>no aside</aside></article>
<section id="comments"><h2>no 3 Comments</h2><div class="comment"><p>I loved this no article, really.</p></div></section>
</div><footer>no &copy; 2020</footer>"""


def test_article_is_told_from_the_rest():
    weights = html_extract.prior()
    text = html_extract.main_text(PAGE, weights)
    assert text.split("\n") == [
        "Title here",
        "First & linked paragraph is long, and tells a story.",
        "Short.",
        "item one",
        "item two",
        "a",
        "b",
    ]
    plain = "<div><p>A long plain text, with commas and all, that is a paragraph in a page without any markup of its own.</p></div>"
    assert html_extract.main_text(plain + "<div><a href=1>x</a> <a href=2>y</a></div>", weights).startswith("A long plain")
    for odd in (None, "", "<", "</p></div>", "<p", "<a href='>", "<script>never closed", "<!-- open", "&#x110000;&bogus;"):
        assert isinstance(html_extract.main_text(odd, weights), str)


def test_open_elements_and_class_words_leave_the_article():
    weights = html_extract.prior()
    story = "A long first paragraph of the story, with commas, and an end that everybody likes to read."
    article = f"<article><h1>Head</h1><p>{story}</p></article>"
    search = "<form><datalist id=d><option value=a>no a<option value=b>no b</datalist></form>"
    for before in (search, "<form><select><option>no a<option>no b</select></form>", "<object data=x>", "<canvas>", "<svg>"):
        assert html_extract.main_text(f"<body>{before}{article}</body>", weights) == f"Head\n{story}", before
    for name in ("content has-sidebar", "social", "share-page", "related comments"):
        page = f"<body><div class='{name}'>{article}<div class='sidebar'><p>no links</p></div></div></body>"
        assert html_extract.main_text(page, weights) == f"Head\n{story}", name
        plain = f"<body><div class='{name}'><p>{story}</p><p>{story}</p></div><footer>no foot</footer></body>"
        assert html_extract.main_text(plain, weights) == f"{story}\n{story}", name
    assert html_extract.main_text(f"{article}<script>open <p>{story}</p>", weights) == f"Head\n{story}"


def test_flow_finds_the_cheapest_labelling():
    rnd = random.Random(1)
    for _ in range(40):
        n = rnd.randint(2, 7)
        odds = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 2)) for a in range(n) for b in range(a) if rnd.random() < 0.6]
        flow = html_extract.Flow(n)
        for i, z in enumerate(odds):
            flow.edge(*((flow.source, i) if z > 0 else (i, flow.sink)), abs(z), 0.0)
        for a, b, w in edges:
            flow.edge(a, b, w, w)
        level = flow.content_side()

        def cost(own):
            wrong = sum(abs(z) for z, o in zip(odds, own) if (z > 0) != o)
            return wrong + sum(w for a, b, w in edges if own[a] != own[b])

        best = min(cost(own) for own in itertools.product([False, True], repeat=n))
        assert cost([level[i] >= 0 for i in range(n)]) == pytest.approx(best)


def test_pages(spark):
    made = [
        f'<html><body><nav><a href="/x">menu{i}</a></nav><article><h1>Head {i}</h1>'
        + "".join(f"<p>Some words, number {k}, make a sentence &lt;{i}&gt;.</p>" for k in range(i % 5 + 1))
        + f'</article><div class="ad">advert{i}</div><footer>foot{i}</footer></body></html>'
        for i in range(40)
    ]
    rows = [(i, f"u{i}", page, "x") for i, page in enumerate(made)]
    rows += [(50, None, None, "x"), (None, "u", "", "x"), (3, "u3", made[3], "x"), (60, "u", "<p>" + "long text, really. " * 30_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = html_extract.train(pages)
    out = html_extract.extract(pages, weights).collect()
    assert len(out) == len(rows)
    want = {}
    for i, page in enumerate(made):
        article = re.search("<article>(.*)</article>", page).group(1)
        want[i] = "\n".join(html.unescape(t) for t in re.split("<[^>]*>", article) if t)
    for r in out:
        if r["page_id"] in want:
            assert r["text"] == want[r["page_id"]]
    assert {r["text"] for r in out if r["page_id"] in (50, None)} == {""}
    assert [len(r["text"]) for r in out if r["page_id"] == 60] == [19 * 30_000 - 1]
    empty = pages.limit(0)
    assert html_extract.extract(empty, html_extract.train(empty)).collect() == []


def test_license_rules(make_docs):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to "
        "permit persons to whom the software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    )
    texts = {
        1: "Words here.\nReleased under the MIT License.\nMore words",
        2: "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.",
        3: "licensed*** under### the%%% apache license, version 2.0. Licensed under CC BY-NC 4.0.",
        4: mit,
        5: "You may obtain a copy of the License at",
        6: None,
        7: "",
        8: "mit license apache gnu " * 20_000,
        9: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.\nNonsense between. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    }
    docs = make_docs([*texts.items(), (1, texts[1]), (None, texts[1])])
    out = license_scan.digest(license_scan.scan(docs)).collect()
    found = {r["doc_id"]: (r["sentence_ids"], r["licenses"], r["unmatched"]) for r in out}
    assert len(out) == len(texts) + 2
    assert found[1] == found[None] == ("mit-short", "MIT", "")
    assert found[2][1] == "Apache-2.0"
    assert found[3][1] == "Apache-2.0,CC-BY-NC-4.0"
    assert found[4] == ("mit-grant,mit-notice", "MIT", "")
    assert found[5] == ("apache-copy", "", "<apache-copy>")
    assert found[6] == found[7] == found[8] == ("", "", "")
    assert found[9] == ("gpl3-free,gpl-warranty", "GPL-3.0-or-later", "")
    assert license_scan.scan(make_docs([])).collect() == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
NAME = """3. Neither the name of the copyright holder nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.
"""


def test_published_notices_are_known(make_docs):
    notices = {
        "Apache-2.0": APACHE,
        "MIT": MIT,
        "GPL-3.0-or-later": GPL.format(3),
        "GPL-2.0-or-later": GPL.format(2),
        "BSD-2-Clause": BSD.format(""),
        "BSD-3-Clause": BSD.format(NAME),
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was "
        "not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    rows, want = [], {}
    for name, notice in notices.items():
        for mark in ("", "# ", "// ", " * "):
            want[len(rows)] = name
            rows.append((len(rows), "Copyright 2020 A. Body\n\n" + "\n".join(mark + line for line in notice.split("\n")) + "\n\ncode"))
    for name, line in (("MIT", "This file is licensed under the MIT License."), ("CC-BY-4.0", "Pictures: Licensed under CC BY 4.0; text too")):
        want[len(rows)] = name
        rows.append((len(rows), line))
    found = license_scan.digest(license_scan.scan(make_docs(rows))).collect()
    assert {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in found} == {i: (name, "") for i, name in want.items()}
    known = {part for _, parts in license_scan.RULES + license_scan.MORE_RULES for part in parts}
    assert known == set(license_scan.SENTENCES | license_scan.MORE_SENTENCES)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m.group())
        if 12 <= len(number) <= 19 and luhn(number):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)


def pii_texts():
    rnd = random.Random(6)
    bits = [
        "a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.0255", "4111 1111 1111 1111",
        "4111-1111-1111-1112", "+1 (555) 555-0100", "+49 30 1234567", "+1", "++12345678901", "5", "12 34", "é", "日本", "\U0001f600",
        "token = \"a1b2c3d4e5f60718293a4b5c6d7e8f90\"", " ", " ", "-", ".", ",", "word", "378282246310005", "\n",
    ]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(300)]
    texts += ["9" * 5000, "a" * 20_000, "1." * 5000, "x@y.z " * 700, "+" + "1 " * 3000, ("4111111111111111 " * 300)]
    return texts


def test_base_spans_equal_python(make_docs):
    texts = pii_texts()
    docs = make_docs([*enumerate(texts), (None, "a@b.c"), (5000, None), (5001, "")])
    out = pii.digest(pii.find(docs)).collect()
    assert len(out) == len(texts) + 3
    for r in out:
        text = "a@b.c" if r["doc_id"] is None else "" if r["doc_id"] >= 5000 else texts[r["doc_id"]]
        spans = base_spans(text)
        named = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest(), text
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[3] == k for s in spans) for k in pii.BASE]
        assert set(named) <= set(r["spans"].split(","))
    assert pii.digest(pii.find(make_docs([]))).collect() == []


def test_addresses_with_zero_parts_are_base_spans(make_docs):
    right = ["10.0.0.1", "192.168.0.1", "8.8.8.0", "127.0.0.1", "0.0.0.0", "00.0.0.1", "000.0255.00.010"]
    wrong = ["256.0.0.0", "0.0.0.0256", "0.300.0.0", "0.0.0."]
    texts = [f"at {t} now" for t in right + wrong]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(make_docs([*enumerate(texts)]))).collect()}
    for i, text in enumerate(texts):
        named = [f"{kind}:{a}:{b}" for a, _, b, kind in base_spans(text)]
        assert found[i]["n_ip"] == (i < len(right)), text
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest(), text
    clean = {r["doc_id"]: r["text"] for r in pii.redact(make_docs([*enumerate(texts)])).collect()}
    assert all(clean[i] == "at [ip] now" for i in range(len(right)))


def test_secrets_are_added_and_numbers_are_not(make_docs):
    rnd = random.Random(2)
    secrets = [f'so the token = "{rnd.randrange(16**40):040x}" is here' for _ in range(30)]
    plain = [f"order {rnd.randrange(10**5)} of version 1.2 and 12 345 things, word by word" for _ in range(30)]
    cards = [f"nothing {n} here" for n in ("4111111111111111", "5500005555555559", "340000000000009")]
    rows = list(enumerate(secrets + plain + cards))
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(make_docs(rows))).collect()}
    assert all(spans[i].startswith("secret:") for i in range(30))
    assert all(spans[i] == "" for i in range(30, 60))
    assert all(spans[i].startswith("card:8:") for i in range(60, 63))


def test_long_secrets_and_spelled_addresses_go_whole(make_docs):
    rnd = random.Random(4)
    made = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    long = [f"so the token={made(2000)} is here" for _ in range(30)]
    spelled = [f"mail {'a' * 70}{i}(at){'.'.join(['part'] * 12)}.com now" for i in range(30)]
    hard = ["token=" * 4000, "a(at)" * 4000, "a(at)" + "b." * 20_000 + "com"]
    docs = make_docs([*enumerate(long + spelled + hard)])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert all(clean[i] == "so the [secret] is here" for i in range(30))
    assert all(clean[i] == "mail [email] now" for i in range(30, 60))


def test_redaction(make_docs):
    docs = make_docs([(1, "mail a.b@c.de, or é +1 (555) 555-0100 now"), (2, None), (3, "clean"), (4, "")])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "mail [email], or é [phone] now", 2: None, 3: "clean", 4: ""}


def test_labelers_that_agree_are_trusted():
    votes = {(1, 1, 1, 1, 0): 80.0, (-1, -1, -1, -1, 0): 80.0, (1, 1, 1, -1, 0): 10.0, (-1, -1, 1, -1, 0): 40.0, (1, 1, -1, 1, 0): 30.0}
    model = pii.estimate(votes)
    right = [model.chance[j][1][2] + model.chance[j][0][0] for j in range(4)]
    assert right[0] > right[2] and right[1] > right[2]
    assert model.posterior((1, 1, -1, 1, 0)) > 0.5 > model.posterior((-1, -1, 1, -1, 0))
