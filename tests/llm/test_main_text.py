"""Main text of pages with comments, adverts, several articles and sections without markup of their own."""

import random

import pytest

from fogline.llm import html_text

P = "<p>" + "Many plain words of a long section stand here. " * 8 + "</p>"
T = " ".join(["Many plain words of a long section stand here."] * 8)
SAY = "<p>I don't think so, and I want to say it at some length here, as readers do.</p>"


@pytest.mark.parametrize(
    "html,text",
    [
        # comments in article markup, within and beside the main text, more of them than of it
        (f"<main><article>{P}</article><div class='comments'>{f'<article class=comment>{SAY * 9}</article>' * 3}</div></main>", T),
        (f"<main>{P}<ol class='commentlist'>{f'<li><article>{SAY * 5}</article></li>' * 4}</ol></main>", T),
        (f"<main>{P}<ol>{f'<li><article>{SAY * 5}</article></li>' * 4}</ol></main>", T),
        (f"<body><article>{P}</article><article class='comment odd'>{SAY}</article></body>", T),
        (f"<body><article>{P}</article><section id=disqus_thread>{SAY * 20}</section></body>", T),
        (f"<main>{P}<aside><article>A teaser of another page.</article></aside></main>", T),
        (f"<body><article>{P}<section class=editor-comment><p>A word of ours.</p></section></article></body>", f"{T}\nA word of ours."),
        # sibling articles
        (f"<body><article><h2>A</h2>{P}</article><article><h2>B</h2>{P * 2}</article></body>", f"A\n{T}\nB\n{T}\n{T}"),
        (f"<body><article><h1>A</h1>{P * 3}</article><article><h3><a href=x>Another title here</a></h3><a href=x>More</a></article></body>", f"A\n{T}\n{T}\n{T}"),
        # divisions of one container, and titles beside the body of a text
        (f"<body><div id=c><div><h2>A</h2>{P}{P}</div><div><h2>B</h2><p>Short</p></div><div><h2>C</h2><p>Also short.</p></div></div></body>", f"A\n{T}\n{T}\nB\nShort\nC\nAlso short."),
        (f"<body><div class=page><div class=hd><h1>Title</h1></div><div class=bd>{P}</div></div></body>", f"Title\n{T}"),
        (f"<body><h1>Title</h1><article>{P}</article></body>", f"Title\n{T}"),
        (f"<body><article>{P}<section id='related-work'><h2>Related work</h2><p>Some did this.</p></section></article></body>", f"{T}\nRelated work\nSome did this."),
        # adverts and notices
        *((f"<body><article>{P}<div class='{name}'>Buy this.</div></article></body>", T) for name in ("adbox", "adsbygoogle", "google_ads_iframe", "sponsored", "AdSlot-3", "top-advertisement")),
        (f"<body><div class=notice>{P}</div><article><h1>T</h1>{P * 3}</article></body>", f"T\n{T}\n{T}\n{T}"),
        *((f"<body><article>{P}<div class='{name}'><p>Not an advert.</p></div></article></body>", f"{T}\nNot an advert.") for name in ("address", "adventure", "admin-guide", "shadow", "commentary")),
        # a wrapper with a name of furniture, and an index whose articles stand in a list
        (f"<body class='comments-open'><div id=page class='sidebar-left'><article>{P}</article><div id=sidebar>{SAY}</div></div></body>", T),
        (f"<main><ul><li><article>{P}</article></li><li><article>{P}</article></li></ul></main>", f"{T}\n{T}"),
        ("<article></article><p>text</p>", "text"),
    ],
)
def test_main_text_of_pages(html, text):
    assert html_text.main_text(html) == text


def test_made_pages_with_comments_several_articles_and_sections():
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "light", "under"]) for _ in range(n)).capitalize() + "."
    for _ in range(120):
        blocks: list[str] = []

        def prose(n, blocks=blocks):
            new = [say(rng.randint(25, 90)) for _ in range(n)]
            blocks.extend(new)
            return "".join(f"<p>{b.replace(' stone ', ' <a href=x>stone</a> ', 1)}</p>" for b in new)

        def headed(level, blocks=blocks):
            blocks.append(say(4))
            return f"<h{level}>{blocks[-1]}</h{level}>"

        kind = rng.choice(["sections", "articles", "divs"])
        if kind == "sections":
            tag = rng.choice(["article", "main"])
            body = f"<{tag}>{headed(1)}{prose(2)}" + "".join(f"<section>{headed(2)}{prose(rng.randint(1, 3))}</section>" for _ in range(rng.randint(1, 3)))
            comment = f"<{rng.choice(['div', 'section'])} class='{rng.choice(['comments', 'comment-list', 'post-comments'])}'>"
            body += comment + "".join(f"<article><p>{say(rng.randint(5, 60))}</p></article>" for _ in range(rng.randint(1, 6))) + f"</{comment[1:].split()[0]}></{tag}>"
        elif kind == "articles":
            body = "".join(f"<article>{headed(2)}{prose(rng.randint(2, 4))}</article>" for _ in range(rng.randint(2, 3)))
        else:
            body = f"<div id=content>{headed(1)}" + "".join(f"<div class=part>{headed(2)}{prose(rng.randint(1, 4))}</div>" for _ in range(rng.randint(2, 4))) + "</div>"
        around = [f"<nav><a href=x>{say(2)}</a></nav>", f"<ins class='adsbygoogle'>{say(20)}</ins>", f"<aside><article>{say(9)}</article></aside>", f"<div class='cookie-notice'>{say(30)}</div>", f"<ol class='commentlist'><li><article class=comment><p>{say(50)}</p></article></li></ol>", f"<footer>{say(9)}</footer>"]
        rng.shuffle(around)
        at = rng.randint(0, len(around))
        html = f"<html><body>{''.join(around[:at])}{body}{''.join(around[at:])}</body></html>"
        assert html_text.main_text(html) == "\n".join(blocks), (kind, html)
