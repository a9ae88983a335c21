"""Labelled pages that the weights of HTML extraction are learned from, drawn from a seed.

Written for this purpose. Elements with the attribute data-main hold the main text, but for those within them that have
data-main="no"; everything else on a page is not. Layouts, names and lengths vary: menus whose names mean nothing,
articles without a tag or a name of their own, boxes inside of articles, text that goes on after its article's end, cards
and comments that are articles, names on single paragraphs.
"""

import random

#: Names that sites give to what surrounds an article, by class or id. Fixed values.
ASIDE_NAMES = (
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail header masthead topbar toolbar footer bottom "
    "cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter signup "
    "subscribe subscription login register search form comment comments commentlist reply replies respond discussion disqus "
    "share sharing social follow related recommended recommendations more popular trending widget tags pagination pager "
    "copyright legal skip toc hidden card cards teaser teasers"
).split()

#: Names of elements around or inside articles. Fixed values.
MAIN_NAMES = "article content main post entry story body text page container wrapper prose lead title headline".split()

#: Names of paragraphs: of an article's own, and of such that don't belong to its text. Fixed values.
OWN_LEAVES = "lead intro first last more text page tags note summary body content main bottom side popular social legal entry story".split()
OTHER_LEAVES = "ad ads advert advertisement sponsor sponsored promo banner comment reply share sharing related newsletter subscribe cookie cookies notice disclaimer copyright hidden breadcrumb pager".split()


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.names = list(ASIDE_NAMES)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.rng.choice("bcdfglmnprstv") + self.rng.choice("aeiou") for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high)))

    def name(self, known: list[str]) -> str:
        """One of the names, alone or with others, or one that means nothing."""
        rng = self.rng
        if rng.random() < 0.4:
            return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
        name = rng.choice(known)
        return rng.choice(["{}", "{}", "{}-x1", "site-{}", "{}_q", "k-{}-z"]).format(name)

    def attribute(self, known: list[str]) -> str:
        return f' {self.rng.choice(["class", "class", "id"])}="{self.name(known)}"' if self.rng.random() < 0.8 else ""

    def links(self, n: int) -> str:
        return "".join(f"<li><a href='/{i}'>{self.words(1, 3)}</a></li>" for i in range(n))

    def cards(self, no: str) -> str:
        """Other articles, or comments, as article elements; the box around them has a name, or they do, or neither."""
        rng, named = self.rng, self.rng.random() < 0.5
        box = rng.choice(["related", "more", "cards", "teasers", "comments", "discussion"]) if named or rng.random() < 0.5 else ""
        each = "" if named else f' class="{rng.choice(["card", "teaser", "comment", "reply"])}"' if rng.random() < 0.7 else ""
        some = "".join(f"<article{each}><h3><a href='/{i}'>{self.words(2, 6)}</a></h3><p>{self.words(5, 20)}</p></article>" for i in range(rng.randint(2, 5)))
        return f'<section{no}{box and f" class={box}"}>{some}</section>'

    def paragraph(self, low: int, high: int, rest: str = "") -> str:
        """One of an article, some with a name of their own."""
        name = f' class="{self.rng.choice(OWN_LEAVES)}"' if self.rng.random() < 0.2 else ""
        return f"<p{name}>{self.words(low, high)}{rest}</p>"

    def aside(self, inside: bool = False) -> str:
        """A menu, an advert, a list of other pages, a form, notices or comments of readers."""
        rng, no = self.rng, ' data-main="no"' if inside else ""
        if rng.random() < 0.12:
            return self.cards(no)
        if rng.random() < 0.25:
            return f'<p{no} class="{rng.choice(OTHER_LEAVES)}">{self.words(2, 22)}</p>'
        kind = rng.randrange(8)
        tag = rng.choice(["div", "section", "aside", "div"])
        if kind == 0:
            tag = rng.choice(["nav", "menu"])
            return f"<{tag}{no}><ul>{self.links(rng.randint(3, 9))}</ul></{tag}>"
        if kind == 1:
            return f'<div{no}{self.attribute(["menu", "nav", "navigation", "navbar", "toc", "breadcrumbs"])}><ul>{self.links(rng.randint(3, 12))}</ul></div>'
        if kind == 2:
            return f'<{tag}{no}{self.attribute(["related", "recommended", "more", "popular", "sidebar"])}><h3>{self.words(1, 3)}</h3>' + "".join(f"<p><a href='/{i}'>{self.words(4, 9)}</a></p>" for i in range(rng.randint(2, 6))) + f"</{tag}>"
        if kind == 3:
            return f"<form{no}{self.attribute(['search', 'login', 'newsletter'])}><label>{self.words(1, 2)}</label><fieldset>{self.words(1, 3)}</fieldset><p hidden>{self.words(1, 4)}</p><button>{self.words(1, 2)}</button></form>"
        if kind == 4:
            each = rng.choice(["li", "li", "div", "div", "div", "article"])
            comments = "".join(f'<{each} class="comment"><p>{self.words(5, 25)}</p></{each}>' for _ in range(rng.randint(1, 5)))
            return f'<{tag}{no} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "replies"])}">{comments}</{tag}>'
        if kind == 5:
            return f'<dialog{no}>{self.words(3, 12)}</dialog><p class="hidden"{no} hidden>{self.words(2, 8)}</p>'
        # every name takes its turn, so that none goes unseen
        if not self.names:
            self.names = list(ASIDE_NAMES)
        name = self.names.pop(rng.randrange(len(self.names)))
        return f'<{tag}{no} {rng.choice(["class", "id"])}="{name}"><p>{self.words(4, 22)}</p></{tag}>'

    def main(self) -> str:
        """Blocks of the main text."""
        rng, out = self.rng, [f"<h1>{self.words(3, 9)}</h1>"]
        for _ in range(rng.randint(3, 9)):
            kind = rng.randrange(9)
            link = f' <a href="/c">{self.words(1, 4)}</a> {self.words(5, 20)}' if rng.random() < 0.4 else ""
            if kind < 5:
                out.append(self.paragraph(15, 90, link))
            elif kind == 5:
                out.append(f"<h2>{self.words(2, 6)}</h2><p>{self.words(12, 60)}</p>")
            elif kind == 6:
                out.append(f"<ul>{''.join(f'<li>{self.words(4, 18)}{link}</li>' for _ in range(rng.randint(2, 5)))}</ul><p>{self.words(12, 50)}</p>")
            elif kind == 7:
                out.append(f"<blockquote>{self.words(10, 30)}</blockquote><table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table><p>{self.words(15, 60)}</p>")
            else:
                out.append(f"<pre>{self.words(5, 20)}</pre><figure><figcaption>{self.words(4, 12)}</figcaption></figure><div>{self.words(20, 70)}</div>")
            if rng.random() < 0.15:
                out.append(self.aside(inside=True))
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        head = f"<html><head><title>{self.words(3, 8)}</title><style>p {{}}</style><script>var x = 1;</script></head><body>"
        top = f"<header{self.attribute(['header', 'masthead', 'topbar'])}><p>{self.words(1, 6)}</p></header>" if rng.random() < 0.6 else f"<div><a href='/'>{self.words(1, 3)}</a></div>"
        bottom = f"<footer{self.attribute(['footer', 'bottom'])}><p>{self.words(3, 14)}</p></footer>" if rng.random() < 0.7 else f"<p><a href='/a'>{self.words(1, 3)}</a> <a href='/b'>{self.words(1, 3)}</a> {self.words(1, 3)}</p>"
        tag, text = rng.choice(["article", "article", "article", "main", "main", "div", "div", "section", "td", ""]), self.main()
        body = f"<{tag}{self.attribute(MAIN_NAMES)} data-main>{text}</{tag}>" if tag else f"<div data-main>{text}</div>"
        if tag == "article" and rng.random() < 0.35:  # the text goes on behind it
            more = "".join(self.paragraph(15, 70).replace("<p", "<p data-main", 1) for _ in range(rng.randint(1, 4)))
            body += rng.choice(["", self.aside()]) + rng.choice([more, f"<div{self.attribute(MAIN_NAMES)} data-main>{self.main()}</div>"])
        if tag == "td":
            body = f"<table><tr><td>{self.aside()}</td>{body}</tr></table>"
        if rng.random() < 0.5:
            body = f"<div{self.attribute(['page', 'container', 'wrapper', 'content', 'main'])}>{body}</div>"
        before = "".join(self.aside() for _ in range(rng.randint(0, 3)))
        after = "".join(self.aside() for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.3:
            after += f"<{(small := rng.choice(['p', 'p', 'div']))}>{self.words(1, 9)}</{small}>"
        top, bottom = (x if rng.random() < 0.6 else "" for x in (top, bottom))
        return f"{head}{top}{before}{body}{after}{bottom}</body></html>"


def labelled_pages(seed: int, n: int) -> list[str]:
    writer = _Writer(seed)
    return [writer.page() for _ in range(n)]
