from postlake.llm import wrappers


def page(n, paragraphs, extra="", end="</body></html>"):
    nav = "".join(f'<li><a href="/{i}">item{n}{i}</a></li>' for i in range(2 + n % 4))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f'<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav>'
        f'<!-- ad {n} --><div class="ad">buy {n}</div>{extra}<article><h1>Head &amp; {n}</h1>{body}</article>'
        f'<aside>side</aside><div class="comments"><p>first!</p></div><footer>&copy; x &middot; {n}</footer>{end}'
    )


def run(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n int")
    found = wrappers.wrappers(table)
    return wrappers.digest(wrappers.extracted(table, found)).collect()


def test_marked_articles(spark):
    rows = [(i, f"https://A.example.com/{i}", page(i, [f"one  {i}", f"two &lt;b&gt;\n{i}"] * (1 + i % 3)), "c", 1) for i in range(30)]
    rows += [
        (100, "https://a.example.com/x", None, "", 0), (101, "https://a.example.com/y", "", "", 0), (102, None, page(1, ["lone"]), "", 0),
        (103, "no url", "<p>bare<p>text", "", 0), (104, "https://a.example.com/z", page(3, ["<b>open<br><p>next <i>in</i>line"], end=""), "", 0),
        (None, "https://a.example.com/z", page(2, []), "", 0), (105, "https://b.example.com", page(4, ["w " * 60_000]), "", 0),
        (105, "https://b.example.com", page(4, ["w " * 60_000]), "", 0),
    ]
    got = run(spark, rows)
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i in range(30):
        assert text[i] == "\n\n".join([f"Head & {i}"] + [f"one {i}", f"two <b> {i}"] * (1 + i % 3))
    assert text[100] == text[101] == "" and text[102] == "Head & 1\n\nlone" and text[103] == "bare\n\ntext"
    assert text[104] == "Head & 3\n\nopen\n\nnext inline" and text[None] == "Head & 2"
    assert text[105].endswith("w w") and all(r.n_chars == len(r.text) for r in got)


def test_unmarked_pages_use_the_wrapper(spark):
    def plain(n):
        body = "".join(f"<p>paragraph {n} {k} with a good deal of text in it</p>" for k in range(1 + n % 5))
        note = "<div>members only</div>" if n % 2 else ""
        return f'<body><div>The Daily Page</div><table><tr><td>in {n}</td></tr></table><div class="story"><h2>Title {n}</h2>{note}{body}</div><div>All rights reserved</div></body>'

    got = {r.page_id: r.text for r in run(spark, [(i, "http://c.example.com/", plain(i), "", 0) for i in range(20)])}
    for i in range(20):
        note = ["members only"] if i % 2 else []
        assert got[i] == "\n\n".join([f"Title {i}", *note, *(f"paragraph {i} {k} with a good deal of text in it" for k in range(1 + i % 5))])


def test_expression():
    held = wrappers.infer([page(i, [f"p{k}" for k in range(1 + i % 3)], "<section>x</section>" if i == 2 else "") for i in range(6)])
    symbols = {w[0]: w[1] for w in held["expression"]}
    assert symbols['["li", "#"]'] is False and symbols['["p", "#"]'] is False
    assert symbols["section"] is True and symbols["article"] is False


def test_no_rows(spark):
    assert run(spark, []) == []


def texts(spark, pages):
    return {r.page_id: r.text for r in run(spark, [(i, "http://d.example.com/", html, "", 0) for i, html in enumerate(pages)])}


def unmarked(n, box, words=20):
    return f'<body><div class="top"><p>The Daily Page</p></div><div class="x"><div {box}><h2>Title {n}</h2><p>{f"story {n} " * words}</p></div></div></body>'


def test_two_templates_of_a_host(spark):
    got = texts(spark, [unmarked(i, 'class="content"' if i % 20 < 13 else 'class="post"') for i in range(60)])
    assert all(got[i] == f"Title {i}\n\n{(f'story {i} ' * 20).strip()}" for i in range(60))


def test_a_rare_template_of_a_large_host(spark):
    got = texts(spark, [unmarked(i, 'class="post"' if i == 7 else 'class="content"') for i in range(80)])
    assert got[7].startswith("Title 7\n\nstory 7") and got[8].startswith("Title 8\n\nstory 8")


def test_one_long_page_decides_nothing():
    plain = [unmarked(i, f'id="slug{"abcdefghijkl"[i]}"', 5_000 if i == 3 else 20) for i in range(12)]
    held = wrappers.Wrapper(wrappers.infer(plain))
    for i, source in enumerate(plain):
        assert held.texts(source)[0] == f"Title {i}" and len(held.texts(source)) == 2


def test_a_marked_page_among_unmarked_ones():
    mixed = [unmarked(i, 'class="content"') + "<div><p>all rights " + "reserved " * 5 + f"{i}</p></div>" for i in range(8)]
    held = wrappers.Wrapper(wrappers.infer([page(9, ["marked"]), *mixed]))
    assert all(held.texts(source) == [f"Title {i}", (f"story {i} " * 20).strip()] for i, source in enumerate(mixed))


def test_alignment_decides_on_marked_pages():
    def marked(n, attribute=""):
        body = "".join(f"<p>part {k} of story {n}</p>" for k in range(1 + n % 3))
        return f'<body><article><h1>Title {n}</h1><h4>Follow our channel</h4><div class="text"{attribute}>{body}</div></article></body>'

    held = wrappers.Wrapper(wrappers.infer([marked(n) for n in range(12)]))
    for n, attribute in ((3, ""), (20, ""), (31, ' hidden=""')):
        assert held.texts(marked(n, attribute)) == [f"Title {n}", "Follow our channel", *(f"part {k} of story {n}" for k in range(1 + n % 3))]
    extra = marked(40).replace("<h4>", "<h5>A line of its own</h5><h4>")
    assert held.texts(extra)[:2] == ["Title 40", "A line of its own"]


def test_copies_keep_their_text():
    near = [f"<body><article><h1>One title</h1><h4>By line</h4><div>{'the same long text ' * 30}</div><h5>{n}</h5></article></body>" for n in range(12)]
    held = wrappers.Wrapper(wrappers.infer(near))
    assert held.texts(near[4]) == ["One title", "By line", ("the same long text " * 30).strip(), "4"]


def headed(n, words):
    parts = "".join(f"<h2>{h}</h2><p>{f'{h.lower()} {n} ' * words}</p>" for h in ("Abstract", "Methods", "Results"))
    return f"<body><div><p>Daily</p></div><article><h1>T</h1>{parts}</article></body>"


def test_constant_headings_stay():
    """Whether the other texts are short or long, and whatever the other pages hold."""
    for words in (1, 3, 60):
        for pages in (5, 12):
            sources = [headed(n, words) for n in range(pages)]
            for source in (sources, [s.replace("article>", "section>") for s in sources]):
                held = wrappers.Wrapper(wrappers.infer(source))
                for n in (0, 4):
                    want = ["T"] + [x for h in ("Abstract", "Methods", "Results") for x in (h, " ".join([h.lower(), str(n)] * words))]
                    assert held.texts(source[n]) == want


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_brute_force(monkeypatch):
    import random

    draw = random.Random(3)
    for small, depth in ((4096, 12), (9, 12), (0, 1)):
        monkeypatch.setattr(wrappers, "SMALL_GAP", small)
        monkeypatch.setattr(wrappers, "DEPTH", depth)
        for _ in range(80):
            a = [draw.choice(("p", "li", "h2", *(f"x{i}" for i in range(60)))) for _ in range(draw.randrange(0, 60))]
            b = [draw.choice(a) if a and draw.random() < 0.1 else x for x in a if draw.random() < 0.9]
            got = wrappers.align(a, b)
            assert all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
            assert len(got) >= 0.85 * longest_common(a, b)
    assert wrappers.align([], ["a"]) == [] and wrappers.align(["a"] * 3, ["a"] * 2) == [(0, 0), (1, 1)]


def test_a_very_long_page():
    import time

    def long(n, blocks):
        body = "".join(f"<p>text {n} {k}</p><h3>Part</h3><ul><li>{k}</li></ul>" if k % 3 else f"<div class=c{k % 7}><h4>{n}</h4></div>" for k in range(blocks))
        return f"<body><nav>x</nav><article>{body}</article></body>"

    held = wrappers.Wrapper(wrappers.infer([long(n, 40 + n) for n in range(5)]))
    start = time.time()
    assert len(held.texts(long(7, 50_000))) == sum(3 if k % 3 else 1 for k in range(50_000))
    assert time.time() - start < 20
