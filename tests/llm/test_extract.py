import html
import random
import re

from glyphmill.llm import extract as e

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c > -->
<header><h1>Site</h1></header><div class="ad">Buy</div><article><h1>Tit&amp;le</h1><p><b>One  two&nbsp;three<br>four<p>Short.</p><aside>Side</aside><ul><li>a<li>b &lt;c&gt;</ul>
<div class="cookie-notice">We use</div><form><p>Mail</p><input></form><section id="comments"><p>First!</p></section><p>1 < 2 &eacute;</p></article><footer>&copy;</footer></body></html>"""


def test_article():
    assert e.main_text(PAGE) == "Tit&le\n\nOne two three four\n\nShort.\n\na\n\nb <c>\n\n1 < 2 é"


def test_surge_and_dive_without_article():
    long = "Sentence of the text that goes on for quite a while, as texts do. " * 3
    page = f"<body><div>Home</div><nav>x</nav><nav>y</nav><div><p>{long}</p><p>Short</p><p>{long}</p></div><nav>z</nav><nav>z</nav><div>Legal</div></body>"
    assert e.main_text(page) == f"{long.strip()}\n\nShort\n\n{long.strip()}"


def test_odd_pages(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>only", "t"), (4, "u", "plain & text", "t"), (5, "u", "<article></article><<>></p></div><!-- open", "t"), (6, "u", "<div>" * 5000 + "deep " * 40000, "t"), (6, "u", "<b>x", "t")]
    found = e.extract(spark.createDataFrame(rows, "page_id long, url string, html string, Text string"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = [(r.page_id, r.text, r.n_chars) for r in found.collect()]
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, "only", 4), (4, "plain & text", 12)]
    assert got[5][2] == 199999 and got[6][1] == "x"
    assert e.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_text_beside_marks_and_behind_adverts():
    one, two, three = (f"Sentence {i} of the text that goes on for quite a while, as texts do. " * 2 for i in "abc")
    one, two, three = one.strip(), two.strip(), three.strip()
    assert e.main_text(f"<div><p>{one}</p><p>{two}</p></div><article>x</article>") == f"{one}\n\n{two}"
    assert e.main_text(f"<article><p>{one}</p><p>Short</p></article><div>Home</div><article><p>{two}</p></article>") == f"{one}\n\nShort\n\n{two}"
    assert e.main_text(f"<p>{one}</p><p>{two}</p><div class=ad>a</div><form>f</form><p>{three}</p>") == f"{one}\n\n{two}\n\n{three}"
    assert e.main_text("<div>Home</div><article>x</article>") == "x"


def plain_text_of(lines):
    """The spans by their definition, line by line, for lines of (text, article)."""
    kept, marked = set(), set()
    lengths = [len(t) for t, _ in lines]
    alike = lambda i, j: 0 <= j < len(lines) and lines[i][1] == lines[j][1] and all(lines[k][1] == lines[i][1] for k in range(min(i, j), max(i, j)))
    for i, (_, article) in enumerate(lines):
        if article:
            block = [j for j in range(len(lines)) if alike(i, j)]
            marked.add(i)
            if e.MARKED * sum(lengths[j] for j in block) > e.SURGE:
                kept.add(i)
            continue
        surge = lambda j: lengths[j] and sum(lengths[k] for k in range(j, j + e.WINDOW) if alike(j, k)) > e.SURGE
        dive = lambda j: not lengths[j] and not (alike(j, j + 1) and lengths[j + 1])
        j = i
        while alike(i, j) and not dive(j):  # back to a surge, over lines without a dive
            if surge(j):
                kept.add(i)
                break
            j -= 1
    chosen = kept or (marked if any(lengths[i] for i in marked) else range(len(lines)))
    return [lines[i][0] for i in sorted(chosen) if lines[i][0]]


def test_spans_against_plain_code():
    rng = random.Random(3)
    for _ in range(3000):
        lines, article, last = [], 0, 0
        for _ in range(rng.randint(0, 14)):
            if rng.random() < 0.3:
                last += 1
                article = rng.choice([0, last])
            lines.append(("x" * rng.choice([0, 0, 3, 20, 60, 100]), article))
        got = [t for lo, hi in e._spans(lines) for t, _ in lines[lo:hi] if t] if lines else []
        assert got == plain_text_of(lines), lines


def page(rng, marks):
    """A page of known text: (html, text)."""
    say = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit & amet", "é", "x<y", "magna"]) for _ in range(n))
    safe = lambda n: html.escape(say(n))
    furniture = [
        lambda: f"<nav><ul><li><a href='/a'>{safe(1)}</a></li><li>{safe(2)}</li></ul></nav>",
        lambda: f"<div class='ad'>{safe(9)}</div>",
        lambda: f"<aside><p>{safe(30)}</p></aside>",
        lambda: f"<div id='cookie-notice'><p>{safe(12)}</p></div>",
        lambda: f"<form><p>{safe(5)}</p><input></form>",
        lambda: "<script>var a = '<p>no</p>';</script><style>p { }</style><!-- <p>no</p> -->",
    ]
    blocks = [f"{say(6)}"] + [say(rng.choice([15, 30, 60])) for _ in range(rng.randint(2, 6))]
    body = f"<h1>{html.escape(blocks[0])}</h1>"
    for b in blocks[1:]:
        words = html.escape(b).split(" ")
        words[rng.randrange(len(words))] += rng.choice(["", "\n ", " <b>", "<br>"])
        body += f"<p>{' '.join(words)}</p>"
        if rng.random() < 0.3:
            body += rng.choice(furniture)()
    tag = rng.choice(["article", "main"]) if marks else "div"
    around = lambda: "".join(rng.choice(furniture)() for _ in range(rng.randint(0, 4)))
    page = f"<!DOCTYPE html><html><head><title>{safe(3)}</title></head><body><header><p>{safe(2)}</p></header>{around()}<{tag}>{body}</{tag}>{around()}<section class='comments'><p>{safe(40)}</p></section><footer>&copy; {safe(3)}</footer></body></html>"
    return page, "\n\n".join(" ".join(b.split()) for b in blocks)


def test_pages_with_and_without_marks():
    rng = random.Random(4)
    for i in range(400):
        source, want = page(rng, marks=i % 2 == 0)
        assert re.sub(r"\s+", " ", e.main_text(source)) == re.sub(r"\s+", " ", want)
        assert e.main_text(source).count("\n\n") == want.count("\n\n")
