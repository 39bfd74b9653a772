from repolith.llm.page_text import blocks, classify, labelled_blocks, main_text
from tests.llm.data import rows

PROSE = ("The council met on the river bank to decide what was to be done with the old mill, and it was not an easy thing to agree on for any of them. "
         "In the end they chose to keep it as it was, for the people of the town had asked that the wheel be left to turn with the water.")  # fmt: skip
OTHER = "Das alte Haus in der Straße ist nicht mehr das, was es war, und die Leute aus dem Ort sind mit dem neuen auch nicht so zufrieden wie sie es mit dem alten waren, das sich so gut in die Landschaft fügte und von allen geliebt war."
LINKS = "<ul>" + "".join(f'<li><a href="/{w}">{w} and the more of it for you</a></li>' for w in ("one", "two", "three")) + "</ul>"


def text(html):
    found = blocks(html)
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def test_article_without_surroundings():
    page = (
        '<!DOCTYPE html><html><head><title>A title</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">'
        f'<header class="site"><h1>The Daily</h1><p>{PROSE}</p></header><nav>{LINKS}</nav><div id="cookie-notice"><p>{PROSE}</p></div><!-- <p>ad</p> -->'
        f'<main><article class="post comments-open"><header><h1>Mills &amp; wheels</h1></header><p>Short.</p><p>{PROSE}<br><p>Odd <b>one</b>.'
        f'<div class="ad">{PROSE}</div><p>Two.</p><form><p>{PROSE}</p><button>Send</button></form><p>One&nbsp;&lt;b&gt;\n three<script>x</script>four</p><footer>{PROSE}</footer>'
        f'<section id="comments"><article><p>{PROSE}</p></article></section></article></main><aside><article><p>{PROSE}</p></article></aside><footer>&copy; {PROSE}</footer></body></html>'
    )
    assert text(page).split("\n") == ["Mills & wheels", "Short.", PROSE, "Odd one.", "Two.", "One <b> threefour"]


def test_page_without_article():
    page = f"<body><div>{LINKS}</div><div><h1>Mills</h1><p>{PROSE}</p><p>Yes.</p><p>{OTHER}</p></div><div><p>Buy now.</p><p>Call us.</p><p>xk zzq vlorp {'qwx ' * 60}</p></div></body>"
    assert text(page).split("\n") == ["Mills", PROSE, "Yes.", OTHER, "Buy now."]  # nearer to prose than to what is none
    assert text(f"<form><div>{PROSE}</div></form>") == ""
    assert text(f"<form><article><p>{PROSE}</p></article></form>") == PROSE
    cyrillic = "слово дело место время человек рука город " * 8
    assert text(f"<p>{cyrillic}</p><p>мало</p>") == cyrillic.strip()


def test_second_pass_takes_the_nearest_label():
    found = blocks(f"<p>{PROSE}</p><p>a</p><p>b</p><p>c</p><div>{'<a href=x>some long link text for all of it here</a> ' * 4}</div><h2>d</h2><p>{PROSE}</p>")
    classify(found)
    assert [(b.text[:1], b.label) for b in found] == [("T", "good"), ("a", "good"), ("b", "bad"), ("c", "bad"), ("s", "bad"), ("d", "good"), ("T", "good")]


def test_broken_markup():
    assert text(f"<article><p title=\"never closed>{PROSE}</p><p class='x'>1 < 2 &am &quo &amp yes</p></article>").endswith("1 < 2 &am &quo & yes")
    assert text("<article><p>end <b") == "end"
    assert text(f"<article><p>{PROSE}</p><script>never closed <p>{PROSE}</p>") == PROSE
    assert text("<p>" * 200_000 + "'\"<x y='" * 100_000) == ""
    assert text("<article>" + "<div>" * 50_000 + "a</article></div>") == "a"
    assert text("<article>one<br>two<br><br>three</article>") == "one two\nthree"
    assert text("<br>" * 50_000 + f"<article><p>{'long ' * 400_000}</p></article>") == ("long " * 400_000).strip()


def test_pages_table(spark):
    page = f"<article><p>{PROSE}</p><p>Ünï</p></article>"
    schema = "page_id long, url string, html string, text string, _html int, _blocks string"
    data = [(1, "u", page, "x", 1, "y"), (1, "u", page, "x", 1, "y"), (2, None, None, None, None, None), (None, "v", "", "", 0, ""), (3, "w", "<nav>a</nav>", "", 0, "")]
    got = main_text(spark.createDataFrame(data, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    both = f"{PROSE}\nÜnï"
    assert rows(got, *got.columns) == sorted([(1, "u", both, len(both))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)], key=repr)
    assert main_text(spark.createDataFrame([], schema)).count() == 0
    first = labelled_blocks(spark.createDataFrame(data[:1], schema), ["page_id"]).first()["_blocks"][0]
    assert first["label"] == "good" and first["stops"] > 20
