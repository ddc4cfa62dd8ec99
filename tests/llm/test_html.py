from html import unescape
import re

from fieldscan.llm import html
from fieldscan.llm.registry import QUERIES, load
from tests.llm.helpers import given

load()


def test_given_pages_give_their_article(spark):
    rows = QUERIES["op8_html_extraction"](spark, "/root/testdata/sf0.001").collect()
    pages = {p["page_id"]: p["html"] for p in given(table="pages")}
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inside))
        want = [" ".join(unescape(x).split()) for x in parts]
        assert r.text == "\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)


def test_furniture_goes_and_short_blocks_follow_their_neighbours():
    long = "It was the best of times and it was the worst of times, " * 4
    page = f"""<html><head><title>no</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header><h1>Site</h1></header><ul class="main-nav"><li><a href=x>Home</a></li></ul><div id=cookie-notice>We use cookies</div>
<div class="adopted"><h2>Head &amp; tail</h2><p>{long}<p>Short one.<br>line &lt;two&gt;</p><p>{long}</div>
<aside>{long}</aside><form><p>{long}</form><section class='user comments'><p>{long}</p></section>
<!-- <p>no</p> --><footer><p>{long}</footer>"""
    line = long.strip()
    assert html.main_text(page) == f"Head & tail\n{line}\nShort one. line <two>\n{line}"


def test_hard_pages(spark):
    odd = [None, "", "plain", "<", "<p", "<p>a<b>c</p></div></p>", "<article><p>one<p>two", "<article>" + "<p>x y</p>" * 20000,
           "<main><div class='ad-slot'>buy</div><h1>T</h1><p><a href='>'>l</a> text &#233;&nbsp;x</p></main>", "<script>never closed"]
    frame = spark.createDataFrame([(i, None, p, 1) for i, p in enumerate(odd)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html.extract(frame).collect()}
    assert [got[i].text for i in (0, 1, 3, 9)] == ["", "", "", ""]
    assert got[6].text == "one\ntwo"
    assert got[7].text.count("\n") == 19999
    assert got[8].text == "T\nl text é x"
    assert html.extract(frame.limit(0)).count() == 0


RUSSIAN = ["В этом году урожай пшеницы оказался выше среднего, и фермеры продают зерно на рынке ближайшего города по хорошей цене.",
           "Погода была тёплой и сухой.", "Осенью поля снова засеют озимыми культурами, если дожди не начнутся раньше обычного срока."]
CHINESE = ["今年小麦的收成高于平均水平，农民在市场上出售粮食。", "天气温暖干燥。", "秋天将再次播种冬小麦。"]
POLISH = ["W tym roku plony pszenicy były wyższe niż zwykle, rolnicy sprzedają zboże na rynku najbliższego miasta.", "Pogoda była ciepła.",
          "Jesienią pola zostaną ponownie obsiane oziminami, jeśli deszcze nie zaczną się wcześniej."]
SHORT = ["Rain came late.", "Fields stayed dry.", "Harvest began in June."]


def test_unmarked_pages_of_any_language_keep_their_text():
    menu = "<nav><a href=/>Home</a></nav><div><a href=1>One link</a> <a href=2>another link</a></div>"
    for lines in (RUSSIAN, CHINESE, POLISH, SHORT):
        body = "".join(f"<p>{x}</p>" for x in lines)
        assert html.main_text(f"<body>{menu}{body}<footer>2024</footer></body>") == "\n".join(lines)
        assert html.main_text(f"<body><div>{menu}</div><article>{body}</article><p>{'It was the end of the day. ' * 9}</p></body>") == "\n".join(lines)
    assert html.main_text("plain") == "plain" and html.main_text("<p>a<b>c</p></div></p>") == "ac"
    assert html.main_text(menu) == ""


def test_both_passes_run_inside_an_article():
    long = ("It was the best of times and it was the worst of times, " * 4).strip()
    links = "".join(f"<li><a href={i}>Another story, number {i}</a></li>" for i in range(3))
    page = f"<article><h1>Head</h1><p>{long}</p><p>Short one.</p><p>{long}</p><ul>{links}<li>Read on</li>{links}</ul></article><p>{long} out</p>"
    assert html.main_text(page) == f"Head\n{long}\nShort one.\n{long}"


def test_given_pages_give_their_article_without_its_marks():
    for p in given("sf0.01", "pages"):
        bare = re.sub(r"</?(?:article|main)\b[^>]*>", "", p["html"])
        assert html.main_text(bare) == html.main_text(p["html"]) != ""
