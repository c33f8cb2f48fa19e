from pyspark.sql import functions as F

from gleaner.functions.markup import clean_page, page_blocks
from gleaner.operators.pages import block_rows, normalize_posts, sections_of
from gleaner.schemas import RAW_POST


def test_blocks_in_order():
    html = """<h2>Plans</h2><p>Two plans.</p><ul><li>One</li><li></li><li>Two</li></ul>
    <ol><li>First</li><li> </li><li>Second</li></ol>
    <table><tr><th>Plan</th><th>Price</th></tr><tr><td>Basic</td><td>$10</td></tr></table>"""
    assert page_blocks(html) == [
        ("heading", 2, "Plans"),
        ("paragraph", None, "Two plans."),
        ("list", None, "- One\n- Two"),
        ("list", None, "1. First\n2. Second"),
        ("table", None, "Plan | Price\nBasic | $10"),
    ]


def test_noise_is_removed():
    html = (
        '<div class="ez-social-bar">Share</div><script>x("<p>no</p>")</script><p>Keep [gallery id="1"] this&nbsp;&nbsp;text</p>'
        '<img src="x"><div class="ad">stays</div><p> </p><aside>no</aside><!-- note -->'
    )
    cleaned = clean_page(html)
    assert cleaned == '<p>Keep  this text</p><div class="ad">stays</div>'
    assert page_blocks(html) == [("paragraph", None, "Keep this text"), ("paragraph", None, "stays")]


def test_contents_list_is_removed():
    html = "<p><strong>Jump to:</strong></p><p>Jump  to</p><ul><li><a href='#a'>A</a></li></ul><ul><li><a href='/x'>X</a></li></ul><p>Body</p>"
    blocks = page_blocks(html)
    assert ("list", None, "- X") in blocks and ("paragraph", None, "Body") in blocks
    assert not any("Jump" in b[2] or "A" == b[2][-1:] for b in blocks)


def test_open_tags_containers_and_other_tags():
    html = "<section>lead <b>bold</b> tail<p><b>one<br><p>two</section><h4>minor</h4>"
    assert [b[2] for b in page_blocks(html)] == ["lead", "bold", "tail", "one", "two", "minor"]
    assert page_blocks("First paragraph.\n\nSecond  paragraph.") == [
        ("paragraph", None, "First paragraph."),
        ("paragraph", None, "Second paragraph."),
    ]
    assert page_blocks("  ") == [] and clean_page(None) == ""


def plain_sections(title, blocks):
    """The section rules said plainly, for comparison."""
    out, above, heading, parts = [], {}, title, []
    for kind, level, text in [*blocks, ("heading", 1, "end")]:
        if kind != "heading":
            parts.append(text)
            continue
        if parts:
            path = [title] + [above[k] for k in sorted(above) if above[k] != title]
            out.append((heading, path, "\n\n".join(parts)))
        above = {k: v for k, v in above.items() if k < level} | {level: text}
        heading, parts = text, []
    return out


def test_sections_agree_with_plain_rules(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(80):
        blocks = []
        for _ in range(rng.randrange(12)):
            if rng.random() < 0.5:
                blocks.append(("heading", rng.choice([1, 2, 3]), rng.choice(["T", "A", "B", "C"])))
            else:
                blocks.append(("paragraph", None, rng.choice(["x", "y"])))
        rows.append((i, blocks))
    df = spark.createDataFrame(rows, "i int, blocks array<struct<kind:string,level:int,text:string>>")
    got = df.select("i", sections_of(F.lit("T"), F.col("blocks")).alias("s")).collect()
    for r in got:
        assert [(s.heading, s.heading_path, s.text) for s in r.s] == plain_sections("T", rows[r.i][1])


def test_normalize_posts(spark):
    html = "<p>Lead.</p><h2>Pricing</h2><p>Ten.</p><h3>Extras</h3><p>More.</p><h2>Empty</h2>"
    posts = spark.createDataFrame(
        [("5", "Acme", "acme", html, "provider", "Acme", None, "2024", None), ("6", "Blank", "", "", "review", None, None, None, None)],
        RAW_POST,
    )
    docs = {r.id: r for r in normalize_posts(posts).collect()}
    assert [(s.heading, s.heading_path) for s in docs["5"].sections] == [
        ("Acme", ["Acme"]),
        ("Pricing", ["Acme", "Pricing"]),
        ("Extras", ["Acme", "Pricing", "Extras"]),
    ]
    assert docs["6"].sections == []
    assert block_rows(posts.select("id", "html")).count() == 6


def test_pages_of_any_depth():
    for tag in ("div", "span", "ul><li"):
        last = tag.rpartition("<")[2]
        html = f"<{tag}>" * 20_000 + "deep" + f"</{last}>" * 20_000 + f"<{tag}>" * 20_000
        assert "deep" in clean_page(html)
        assert [b[2].removeprefix("- ") for b in page_blocks(html)] == ["deep"]
    assert clean_page("<div>" * 20_000) == ""
    assert page_blocks("<div>" * 20_000 + "<h2>A</h2>b") == [("heading", 2, "A"), ("paragraph", None, "b")]
