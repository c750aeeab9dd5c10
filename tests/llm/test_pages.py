import random

from duskveil.llm import pages as P
from helpers import rows

PAGES = "page_id bigint, url string, html string"
FURNITURE = "<p>Our shop is open all day.</p><p>Call the desk for help.</p>"


def lines(html):
    return [x.text for x in P.page_lines(html) if not x.marked]


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_longest(monkeypatch):
    random.seed(1)
    for bits in (1 << 26, 8):
        monkeypatch.setattr(P, "TABLE_BITS", bits)
        for _ in range(800):
            a = [random.randint(0, 4) for _ in range(random.randint(0, 11))]
            b = [random.randint(0, 5) for _ in range(random.randint(0, 11))]
            found = P.common_lines(a, b)
            rest = iter(b)
            assert found == sorted(set(found)) and all(a[i] in rest for i in found)
            assert len(found) == longest(a, b)


def test_markup():
    assert lines(None) == lines("") == lines("<nav>x</nav><script>if (a<b) '</p>'</script>") == []
    assert lines("<p>a &amp; b&nbsp;c<br>d</p>  <p> e\n f </p>") == ["a & b c d", "e f"]
    assert lines("<p>un<b>closed") == ["unclosed"]
    assert lines("<p class=ad>Buy<p>Real text.</p><div id='comments'><p>No</p></div><footer>f") == ["Real text."]
    page = "<nav>n</nav><div>outside</div><article><header><h1>Head</h1></header><p>Body.</p><aside>z</aside></article><form>q</form>"
    assert lines(page) == ["Head", "Body."]
    assert lines("<article><p>t.</p><article class='comment'><p>c</p></article><p>u.</p></article>") == ["t.", "u."]
    assert lines("<nav>never closed<article><p>x.</p></article>") == ["x."]


def page(i, body):
    return f"<html><body>{FURNITURE}{body}</body></html>"


def test_template_lines_go(spark, partitions):
    body = [f"<p>Text number {i} tells of thing {i * i}.</p><p>More on {i}, again and {i}.</p>" for i in range(40)]
    made = [(i, f"https://Host{i % 2}.example/a/{i:03d}", page(i, b)) for i, b in enumerate(body)]
    made.append((40, "https://alone.example/x", page(40, "<p>Single.</p>")))
    made.append((40, "https://alone.example/x", page(40, "<p>Single.</p>")))
    made += [(41, None, None), (None, "", ""), (42, "no url", "<p>Odd.</p>")]
    df = spark.createDataFrame(made, PAGES)
    want = None
    for n in (1, 5):
        partitions(n)
        found = rows(P.main_text(df))
        want = want or found
        assert found == want
    by_id = {r[0]: r[2] for r in want}
    assert by_id[7] == "Text number 7 tells of thing 49.\nMore on 7, again and 7."
    # a page alone on its host, even twice, has nothing to be compared with
    assert by_id[40] == "Our shop is open all day.\nCall the desk for help.\nSingle."
    assert by_id[41] == "" and by_id[None] == "" and by_id[42] == "Odd." and len(want) == len(made)
    assert P.main_text(df.limit(0)).count() == 0


def test_article_prose_stays(spark):
    same = "<article><h1>Shared title</h1><p><a href='/'>More from us</a></p><p>The very same sentence stands here.</p><p>{}.</p><p>{} and {} and {}.</p></article>"
    made = [(i, f"http://h.example/{i}", same.format(i, *"xyz"[:3]).replace("x", f"long{i}" * 9)) for i in range(3)]
    found = P.main_text(spark.createDataFrame(made, PAGES)).collect()
    # furniture that the pages share goes, a heading and prose that they share stay
    assert all(r["text"].startswith("Shared title\nThe very same sentence") for r in found)


def test_attributes_are_names_and_values():
    assert lines("<article title='A hidden gem'><p>Kept.</p></article>") == ["Kept."]
    assert lines("<div data-x='class=ad hidden'><p>Kept.</p></div>") == ["Kept."]
    for attribute in ("hidden", "HIDDEN=''", "aria-hidden='true'", "style='color:red; display : none'", "class='x ad'"):
        assert lines(f"<div {attribute}><p>Gone.</p></div><p>Kept.</p>") == ["Kept."]
    assert lines("<p title='a > b'>One.</p><a href='x?hidden=1'>Two.</a>") == ["One.", "Two."]


def test_alignment_alone_removes_what_neighbours_share(spark):
    nav = "<nav>Home<br>Shop</nav><div class='notice'>We use cookies on this site</div>"
    foot = "<footer>All about us</footer>"
    made = [
        (i, f"http://h.example/a/{i}", f"{nav}<p>Text {i} about {i * i}.</p><p>Then {i} ends with {-i}.</p>{foot}")
        for i in range(6)
    ]
    # copies between two pages do not keep them from a page that differs
    made += [(100 + i, f"http://h.example/a/3?print={i}", made[3][2]) for i in range(4)]
    df = spark.createDataFrame(made, PAGES)
    alone = {r["page_id"]: r["text"] for r in P.main_text(df, lists=False, copy_share=0.9).collect()}
    both = {r["page_id"]: r["text"] for r in P.main_text(df).collect()}
    assert alone == both == {
        i: f"Text {j} about {j * j}.\nThen {j} ends with {-j}." for i, j in [*((i, i) for i in range(6)), *((100 + i, 3) for i in range(4))]
    }


def test_pairing_against_plain_python(spark, partitions):
    """Every page's partner, found by comparing all pages of a host."""
    partitions(5)
    random.seed(3)
    made = []
    for i in range(60):
        host = random.choice("abc")
        body = "".join(f"<p>{random.choice('stuvwxyz')} line</p>" for _ in range(random.randint(0, 6)))
        made.append((i, f"http://{host}.example/{random.randint(0, 40):02d}", body + f"<p>own {i}</p>"))
    found = {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(made, PAGES)).collect()}
    for i, url, html in made:
        own = [x.text for x in P.page_lines(html)]
        host, path = url[7:16], url[16:]
        order = sorted(
            (u[16:], h) for _, u, h in made if u[7:16] == host
        )
        texts = found[i].split("\n")
        # what is left is a subsequence of the page, and what went stands in a page beside it
        rest = iter(own)
        assert all(t in rest for t in texts)
        gone = list(own)
        for t in texts:
            gone.remove(t)
        if gone:
            spots = [k for k, (p, h) in enumerate(order) if h == html and p == path]
            near = [order[k + d][1] for k in spots for d in (-2, -1, 1, 2) if 0 <= k + d < len(order)]
            assert any(all(g in [x.text for x in P.page_lines(h)] for g in gone) for h in near)
