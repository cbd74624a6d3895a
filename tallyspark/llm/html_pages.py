"""Leaf blocks of HTML pages, and labelled pages to learn from."""

from __future__ import annotations

import html
import random
import re
from typing import NamedTuple

#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page. That of raw ones ends at their end tag only, and a slash does not close them.
RAW = "script|style|title|textarea|iframe"
SKIPPED = "noscript|template|object|select|canvas|audio|video"
FOREIGN = "svg|math"
#: A tag of these ends an open drawing or formula.
ENDS_FOREIGN = (
    "article|aside|b|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|footer|h[1-6]|head|header|hr|i|img|li|main|menu|"
    "meta|nav|ol|p|pre|ruby|s|section|small|span|strong|strike|sub|sup|table|tt|u|ul|var"
)
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "button", "label", "caption", "option", "optgroup", "legend"}
#: An element that ends an open one of the same set, up to the set's container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|(?=<body[\s>])|\Z)"
    rf"|<(?P<skipped>{SKIPPED})(?=[\s/>])[^>]*+(?<!/)>.*?(?:</(?P=skipped)\s*>|(?=<body[\s>])|\Z)"
    rf"|<(?P<foreign>{FOREIGN})(?=[\s/>])[^>]*+(?<!/)>.*?(?:</(?P=foreign)\s*>|(?=</?(?:{ENDS_FOREIGN})[\s/>])|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that a block's path holds at most; a broken page may nest them without end.
MAX_DEPTH = 400


class Block(NamedTuple):
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # elements around, with the words of their names
    link_chars: int


def name_parts(attrs: str) -> tuple[str, ...]:
    """Words of class, id, role and itemprop: letters, lower-cased."""
    if "=" not in attrs:
        return ()
    parts = []
    for m in _NAMES.finditer(attrs):
        parts += [p.lower() for p in _PARTS.findall(m[1] or m[2] or m[3] or "")]
    return tuple(dict.fromkeys(parts))


def leaf_blocks(page: str) -> list[Block]:
    """Texts between block elements, in order, references decoded, white space as single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, path, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    def add(raw: str) -> None:
        nonlocal linked, path
        text = html.unescape(raw) if "&" in raw else raw
        if not parts:
            if text.isspace():
                return
            path = tuple(stack)
        parts.append(text)
        if links:
            linked += len(text)

    path: tuple = ()
    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if (m["raw"] or m["skipped"] or "").lower() in ("title", "select"):
                flush()
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline end tag ends nothing outside its block
            continue
        if tag == "br":
            parts.append(" ") if parts else None
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            if tag in SIBLINGS:
                same, stop = SIBLINGS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in stop:
                        break
                    if stack[k][0] in same:
                        pop_to(k)
                        break
        if tag in VOID or (m["attrs"] or m["attrs2"] or "").endswith("/") and tag not in BLOCK:
            continue
        if len(stack) < MAX_DEPTH:
            stack.append((tag, name_parts(m["attrs"] or m["attrs2"] or "")))
            links += tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return out


#: Names that pages give to what is not the article, and to the article.
BOILERPLATE = {
    "menu": ("nav", "menu navbar nav navigation topnav breadcrumb breadcrumbs mainmenu pagination pager tabs toolbar submenu"),
    "header": ("header", "header masthead branding topbar siteheader logo banner tagline pageheader"),
    "footer": ("footer", "footer sitefooter bottom copyright colophon legal imprint footnav credits"),
    "sidebar": ("aside", "sidebar widget widgets rail secondary related recommended trending popular tagcloud archives blogroll teaser more"),
    "notice": ("div", "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall announcement toast message"),
    "advert": ("div", "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp outbrain taboola adslot"),
    "form": ("form", "form search searchbox login register contact poll survey"),
    "comments": ("section", "comments comment commentlist disqus replies reply respond discussion responses feedback reviews thread"),
    "social": ("div", "share social sharing follow sharebar twitter facebook likes"),
}
ARTICLE = ("article", "article content post entry story articlebody text main body maincontent blogpost document page")
PHRASES = {
    "notice": "We use cookies|Accept all|Manage preferences|Subscribe to our newsletter|Please sign in to continue",
    "advert": "Advertisement|Sponsored|Buy now and save|Special offer",
    "form": "Search|Email address|Your name|Send|Log in|Password",
    "social": "Share|Tweet|Follow us|Like",
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Contact",
    "comments": "Reply|Leave a comment|3 comments|Posted by guest",
    "header": "Home|Sign in|The daily page",
    "sidebar": "Related articles|Most read|Tags|Recent posts",
    "menu": "Home|About|Contact|News|Products",
}


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of a random layout, and for each of its leaf blocks whether it is of the article."""
    syllables = "an be ta ri con de mo la ver sti ung el the or nd ku sch ció ment ö é pa".split()

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def sentence(n: int) -> str:
        w = [word() for _ in range(n)]
        mark = rng.choice((".", ".", ".", "!", "?", "", "&amp;", "###"))
        return " ".join(w).capitalize() + mark

    def prose() -> str:
        size = rng.choice((1, 1, 2, 3, 5, 8))
        return " ".join(sentence(rng.choice((1, 3, 8, 15, 25))) for _ in range(size))

    def short() -> str:
        return " ".join(word() for _ in range(rng.randint(1, 4)))

    out: list[str] = []
    labels: list[int] = []

    def leaf(tag: str, text: str, label: int, attrs: str = "") -> None:
        out.append(f"<{tag}{attrs}>{text}</{tag}>")
        labels.append(label)

    def name(words: str) -> str:
        chosen = rng.choice(words.split())
        chosen = rng.choice((chosen, chosen, f"site-{chosen}", f"{chosen}-{rng.randint(1, 9)}", f"{chosen}Box", f"main_{chosen}"))
        return f' {rng.choice(("class", "class", "id"))}="{chosen}"'

    def links(tag: str = "ul") -> None:
        out.append(f"<{tag}>")
        for _ in range(rng.randint(2, 8)):
            leaf("li", f'<a href="/{word()}">{short()}</a>', 0)
        out.append(f"</{tag}>")

    def junk(kind: str) -> None:
        tag, names = BOILERPLATE[kind]
        semantic = rng.random() < 0.5
        tag = tag if semantic else rng.choice(("div", "div", "section", "span" if kind == "none" else "div"))
        attrs = "" if semantic and tag not in ("div", "section") and rng.random() < 0.6 else name(names)
        out.append(f"<{tag}{attrs}>")
        phrase = rng.choice(PHRASES[kind].split("|"))
        if kind == "menu":
            links(rng.choice(("ul", "ol")))
        elif kind == "header":
            leaf(rng.choice(("h1", "div", "p")), short(), 0)
            if rng.random() < 0.5:
                links()
        elif kind == "footer":
            if rng.random() < 0.5:
                links()
            leaf(rng.choice(("p", "div")), rng.choice((phrase, f"&copy; {short()} &middot; {sentence(6)}")), 0)
        elif kind == "sidebar":
            leaf(rng.choice(("h2", "h3", "h4")), rng.choice((phrase, short())), 0)
            links() if rng.random() < 0.7 else leaf("p", prose(), 0)
        elif kind == "form":
            leaf("label", phrase, 0)
            out.append('<input type="text" name="q">')
            leaf("button", short(), 0)
            if rng.random() < 0.3:
                leaf("p", sentence(8), 0)
        elif kind == "comments":
            leaf(rng.choice(("h2", "h3")), phrase, 0)
            for _ in range(rng.randint(1, 4)):
                out.append("<div" + (name(names) if rng.random() < 0.6 else "") + ">")
                if rng.random() < 0.5:
                    leaf(rng.choice(("h4", "div", "p")), short(), 0)
                for _ in range(rng.randint(1, 2)):
                    leaf("p", prose(), 0)
                out.append("</div>")
        elif rng.random() < 0.4:
            out.append(rng.choice((phrase, prose(), sentence(6))))
            labels.append(0)
        else:
            leaf(rng.choice(("p", "div", "h3")), rng.choice((phrase, prose())), 0)
            if kind == "notice" and rng.random() < 0.5:
                leaf("button", short(), 0)
        out.append(f"</{tag}>")

    for kind in ("notice", "header", "menu", "advert", "form"):
        if rng.random() < 0.55:
            junk(kind)
    wrapped = rng.random() < 0.4
    if wrapped:
        out.append(rng.choice(("<main>", "<div>", '<div class="wrapper">', '<div id="page">', '<div id="content">')))
        if rng.random() < 0.3:
            junk(rng.choice(("sidebar", "advert", "menu")))
    semantic = rng.random() < 0.6
    tag = rng.choice(("article", "article", "main")) if semantic else rng.choice(("div", "div", "section", "td"))
    if tag == "td":
        out.append("<table><tr>")
    attrs = name(ARTICLE[1]) if rng.random() < (0.3 if semantic else 0.85) else ""
    out.append(f"<{tag}{attrs}>")
    if rng.random() < 0.8:
        if rng.random() < 0.2:
            out.append("<header>")
            leaf("h1", sentence(5), 1)
            out.append("</header>")
        else:
            leaf(rng.choice(("h1", "h1", "h2")), sentence(rng.randint(1, 9)), 1)
    for _ in range(rng.choice((1, 2, 4, 8, 14))):
        kind = rng.random()
        if kind < 0.72:
            text = prose()
            if rng.random() < 0.2:
                text = f"{short()} <a href='/x'>{short()}</a> {text}"
            if rng.random() < 0.2:
                text = f"<b>{text}<br>"
            leaf("p", text, 1)
        elif kind < 0.8:
            leaf(rng.choice(("h2", "h3")), short(), 1)
        elif kind < 0.86:
            out.append("<ul>")
            for _ in range(rng.randint(2, 5)):
                leaf("li", sentence(rng.randint(2, 10)), 1)
            out.append("</ul>")
        elif kind < 0.9:
            leaf(rng.choice(("blockquote", "pre")), sentence(12), 1)
        elif kind < 0.93:
            leaf("p", rng.choice(("Released under the MIT License.", "All rights reserved.", "Contact us by mail at a@b.example", "© 2020 by the author")), 1)
        else:
            junk(rng.choice(("advert", "social", "sidebar", "form", "notice")))
    if rng.random() < 0.25:
        junk(rng.choice(("comments", "social", "sidebar")))
    out.append(f"</{tag}>")
    if tag == "td":
        if rng.random() < 0.6:
            out.append("<td" + name(BOILERPLATE["sidebar"][1]) + ">")
            links()
            out.append("</td>")
        out.append("</tr></table>")
    for kind in ("comments", "sidebar", "advert"):
        if rng.random() < 0.4:
            junk(kind)
    if wrapped:
        out.append("</main></div>")
    for kind in ("form", "notice", "footer"):
        if rng.random() < (0.8 if kind == "footer" else 0.2):
            junk(kind)
    return "<html><body>" + "\n".join(out) + "</body></html>", labels


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]
