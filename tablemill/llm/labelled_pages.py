"""Pages with labelled parts: data-content="1" marks the main text, data-content="0" what stands around it."""

WORDS = (
    "The river rose in the night, and by morning the lower fields were under water. Farmers moved their cattle to the ridge, where the old barn still stood. ",
    "Nobody in the village could remember a spring like it, though the parish books speak of worse. ",
    "Engineers who looked at the dam said that the gates had held, but that the spillway needs repair before autumn. ",
    "It was short. ",
    "La ville se réveille lentement, et les marchands ouvrent leurs volets sous une pluie fine qui ne cesse pas. ",
    "Der Zug hielt auf freier Strecke, weil ein Baum auf die Gleise gefallen war, und niemand wusste, wie lange es dauern würde. ",
    "El mercado abre temprano, y los vecinos llegan con cestas para comprar pan, fruta y queso de la sierra. ",
    "LEVELS ARE RISING!! WARDENS!! SAY",
    "water water water water water water over over over over the the the the bridge bridge bridge",
    "No reply",
    "Gate | open | shut | 4.2 | 4.4 | ridge | barn | dam.",
)
LONG = WORDS[0] * 3 + WORDS[4] * 3 + WORDS[5] * 2


def _p(*numbers: int, tag: str = "p") -> str:
    return "".join(f"<{tag}>{WORDS[i % len(WORDS)]}</{tag}>" for i in numbers)


def _links(*names: str) -> str:
    return "<ul>" + "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names) + "</ul>"


NAV = '<nav data-content="0">' + _links("Home", "World", "Sport", "Travel", "About us") + "</nav>"
HEADER = '<header data-content="0"><a href="/">Daily Sheet</a><p>News since 1901, every day and for everyone who reads.</p></header>'
FOOTER = '<footer data-content="0">&copy; Daily Sheet &middot; ' + WORDS[1] + '<a href="/imprint">Imprint</a></footer>'
AD = '<div class="ad" data-content="0">' + WORDS[2] + "</div>"
LONG_AD = '<div class="advert banner" data-content="0"><p>' + WORDS[0] + WORDS[1] + '</p><a href="/buy">Buy now</a></div>'
SPONSOR = '<section class="sponsored-promo" data-content="0"><h3>Sponsored</h3>' + _p(0, 4) + "</section>"
COOKIE = '<div id="cookie-consent" class="notice" role="alert" data-content="0"><p>We use cookies to make this site better. By reading on you accept them.</p><button>Accept</button></div>'
SIDEBAR = '<aside class="sidebar widget" data-content="0"><h3>Most read</h3>' + _links("A storm at sea", "Ten quiet walks", "Bread again") + _p(5) + "</aside>"
COMMENTS = '<section id="comments" class="comments" data-content="0"><h2>3 comments</h2><div class="comment"><p>' + WORDS[1] + '</p></div><div class="comment reply"><p>' + WORDS[0] + "</p></div></section>"
DISCUSSION = '<div class="discussion" data-content="0"><ul><li class="comment-body"><p>' + WORDS[2] + "</p></li><li class=\"comment-body\"><p>I disagree.</p></li></ul></div>"
FORM = '<form class="newsletter subscribe" data-content="0"><p>Get our letter every morning, free of charge.</p><label>Email</label><input name="e"><button>Sign up</button></form>'
LOGIN = '<form id="login" data-content="0"><label>Name</label><input><label>Password</label><input><p>Forgot it?</p></form>'
SHARE = '<div class="share social" data-content="0"><a href="#f">Share</a> <a href="#t">Post</a></div>'
RELATED = '<div class="related" data-content="0"><h3>Related stories</h3>' + _links("The dam", "The ridge", "The barn") + "</div>"
CRUMBS = '<div class="breadcrumb" data-content="0"><a href="/">Home</a> &gt; <a href="/w">World</a></div>'
PAGER = '<div class="pagination" data-content="0"><a href="?1">1</a> <a href="?2">2</a></div>'
MENU = '<div class="menu" data-content="0">' + _links("Start", "Shop", "Contact") + "</div>"
SEARCH = '<div class="search-form" role="search" data-content="0"><form><input><button>Search</button></form></div>'
LEGAL = '<div class="legal copyright" data-content="0"><p>All rights reserved. No part may be copied without leave of the publisher.</p></div>'
POPUP = '<div class="modal popup" data-content="0"><p>Wait! Before you go, read our offer of the week, which ends soon.</p></div>'


def _article(*numbers: int, inside: str = "", tag: str = "article", names: str = "", title: str = "") -> str:
    return f'<{tag} {names} data-content="1"><h1>{title or "River in flood"}</h1>{_p(*numbers)}{inside}</{tag}>'


def _page(*parts: str) -> str:
    return '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>' + "".join(parts) + "</body></html>"


LIST = "<h2>What to do</h2><ul><li>Move the animals.</li><li>Call the wardens.</li><li>Stay on the ridge.</li></ul>"
QUOTE = '<blockquote><p>"We have seen worse," said the warden.</p></blockquote><pre>gate 1: open</pre><table><tr><td>Day</td><td>Level</td></tr><tr><td>1</td><td>4.2 m</td></tr></table>'
LINKED = '<p>The report is <a href="/r">on the county site</a>, with maps of <a href="/m">all the fields</a> that were hit.</p><figure><img src="x"><figcaption>The dam at noon.</figcaption></figure>'

BEFORE = (NAV, AD, HEADER, COOKIE, CRUMBS, SEARCH, LOGIN, MENU, LONG_AD, POPUP)
AFTER = (COMMENTS, SIDEBAR, RELATED, DISCUSSION, FORM, SPONSOR, SHARE, PAGER, LEGAL, AD)
BODIES = (
    ("article", ""), ("main", ""), ("div", 'class="post-content"'), ("article", 'class="story-text"'), ("div", 'id="content" class="entry-body"'),
    ("section", 'class="story"'), ("main", 'class="content"'), ("div", 'class="text"'), ("article", ""), ("div", 'class="article-main"'),
)
INSIDE = ("", LIST, QUOTE, LINKED, FORM + "<p>It went on for days.</p>", "<p><b>Bold words.<br><p>" + WORDS[3] + "</p>", SHARE, AD + "<p>" + WORDS[2] + "</p>", "<p>Yes</p><p>1</p>", f"<p>{LONG}</p>", "<p><b>" + WORDS[8] + "<br>")
TITLES = ("", WORDS[0], WORDS[8], WORDS[7], WORDS[9], "Bread", WORDS[1])
WRAPS = (("", ""), ("", ""), ('<div class="container wrap">', "</div>"), ('<div id="page">', "</div>"), ('<main class="content">', "</main>"))


def _nth(i: int) -> str:
    """The i-th page: every part comes with every other one sooner or later."""
    tag, names = BODIES[i % len(BODIES)]
    numbers = [(i * k + k) % len(WORDS) for k in range(1, 1 + i % 6)]
    open_, close = WRAPS[i % len(WRAPS)]
    before = [BEFORE[(i + k * 3) % len(BEFORE)] for k in range(1 + i % 4)]
    after = [AFTER[(i * 7 + k) % len(AFTER)] for k in range(i % 4)]
    middle = _article(*numbers, inside=INSIDE[i % len(INSIDE)], tag=tag, names=names, title=TITLES[i % len(TITLES)]) if i % 13 else ""
    return _page(*before, open_, middle, *after, close, FOOTER if i % 6 else LEGAL)


PAGES = tuple(_nth(i) for i in range(240))
