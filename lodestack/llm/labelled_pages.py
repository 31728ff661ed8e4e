"""Labelled web pages for fitting the model of `html_text`: made by rule from a seed.

Elements that hold main text carry the attribute data-gold. Layouts, element and class names, the
place of menus, adverts, forms and comments, and the lengths of texts vary; the words are invented,
so that a model can't learn a language."""

from __future__ import annotations

import random

# Names and phrases that pages use.
SYLLABLES = "an ta re lo mi ver sch ou ent ción é ß ing st wh on ar eau qu ñ".split()
COMMON = "the of and to in is for with that our your all more this der die und das nicht de la que el en los les des est une pour".split()
MAIN = [
    "article", "article", "article class=post", "main", "main id=content", "div id=content", "div class=article-body", "div class=entry-content", "div class=post-content",
    "section class=story", "div id=main", "div role=main", "div class=text", "div", "div class=post", "section", "div itemprop=articleBody", "div id=main-content",
]
WRAPPERS = ["div class=page", "div id=wrapper", "div class=container", "main", "div class=row", "div class=layout", "section", "div", "div class=site-content", "div class=column"]
MENUS = ["nav", "nav class=main-nav", "div class=menu", "div id=navigation", "nav class=breadcrumb", "div class=breadcrumbs", "div class=pagination", "div class=toc", "div class=tags", "nav role=navigation", "div class=navbar", "div class=topbar"]
HEADERS = ["header", "header class=site-header", "div id=header", "div class=masthead", "div class=site-branding", "header role=banner", "div class=top-header"]
FOOTERS = ["footer", "footer", "div id=footer", "div class=site-footer", "footer role=contentinfo", "p class=copyright", "div class=footer-bottom", "div class=legal"]
SIDES = ["aside", "div class=sidebar", "div id=sidebar", "div class=widget", "section class=related", "div class=recommended", "div class=most-read", "aside class=related-posts", "div class=right-rail", "div class=trending", "aside role=complementary", "div class=author-bio"]
NOTICES = ["div class=cookie-notice", "div class=gdpr", "div id=cookie-consent", "div class=alert", "div class=notice", "div class=notification", "div class=popup", "div class=modal", "div class=paywall", "div role=alert", "div class=disclaimer", "div class=cookie-banner", "div role=dialog", "section class=announcement"]
ADVERTS = ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "div class=promo", "aside class=ad", "div id=ad-slot", "div class=banner-ad", "div class=ad-container", "section class=promotion"]
FORMS = ["form", "form class=newsletter", "form class=login", "div class=search", "form id=comment-form", "div class=subscribe", "form role=search", "div class=signup"]
COMMENTS = ["section id=comments", "div class=comments", "ol class=comment-list", "div id=comments", "section class=discussion", "div class=responses", "div class=user-comments", "div class=reviews", "section class=reader-comments", "div class=replies"]
SHARES = ["div class=share", "ul class=social", "div class=social-links", "div class=share-buttons"]
PHRASES = {
    "header": ["Daily News", "The Gazette", "Welcome", "Home", "Blog", "Your trusted source"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies. Read our privacy policy.", "Please enable JavaScript.", "Subscribe to continue reading.", "Notice: maintenance tonight.", "You have reached your limit of free articles.", "Dismiss"],
    "advert": ["Advertisement", "Sponsored", "Buy now and save 50%!", "Limited offer: order today.", "Ad", "Click here"],
    "form": ["Search", "Sign up", "Enter your email", "Subscribe", "Log in", "Password", "Send", "Leave a reply", "Sign up for our newsletter", "Name", "Post comment"],
    "comments": ["Comments", "3 comments", "Reply", "Like", "Report", "Join the discussion", "Show more comments", "Leave a comment"],
    "side": ["Related", "Related articles", "Most read", "Popular posts", "You may also like", "Recommended", "Trending", "About the author", "Read more"],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Contact", "Imprint", "Powered by"],
    "share": ["Share", "Tweet", "Share on Facebook", "Email", "Print", "Copy link"],
}


class _Page:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.pick = self.rng.choice
        self.noise = self.rng.random() < 0.2  # texts full of signs
        self.signs = self.rng.sample(["***", "%%%", "&amp;&amp;", "###", "$$$", " |", " ·", "»", "_", " ~", "|", " -", "?", ":", ";"], self.rng.randint(1, 5))

    def word(self) -> str:
        if self.rng.random() < 0.45:
            w = self.pick(COMMON)
        elif self.rng.random() < 0.06:
            n = self.rng.randint(0, 99_999)
            w = self.pick([str(n), f"{n % 28 + 1}.{n % 12 + 1}.{1990 + n % 35}", f"a{n}@example.org", f"https://example.org/{n}", f"{n:x}", "©", f"{n},5", "Licensed", "Copyright", f"{1990 + n % 35}", "="])
        else:
            w = "".join(self.pick(SYLLABLES) for _ in range(self.rng.randint(1, 4)))
        return w + (self.pick(self.signs) if self.noise else "")

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            s = self.words(1, 16)
            s = s[:1].upper() + s[1:]
            out.append((s.replace(" ", ", ", 1) if self.rng.random() < 0.4 else s) + self.pick(["."] * 6 + ["!", "?", ""]))
        return " ".join(out)

    def inline(self, text: str) -> str:
        roll = self.rng.random()
        if roll < 0.15:
            return f"<b>{text}</b>" if roll < 0.1 else f"<b>{text}<br>"
        if roll < 0.3 and " " in text:
            a, b = text.split(" ", 1)
            return f'{a} <a href="/{roll}">{self.words(1, 3)}</a> {b}'
        return text

    def wrap(self, element: str, inner: str, extra: str = "") -> str:
        tag, _, attribute = element.partition(" ")
        if attribute:
            name, value = attribute.split("=")
            extra += f' {name}="{value}"'
        return f"<{tag}{extra}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 7, phrases: str | None = None) -> str:
        names = [self.pick(PHRASES[phrases]) if phrases and self.rng.random() < 0.5 else self.words(1, 4) for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.75:
            return "<ul>" + "".join(f'<li><a href="/{n[:3]}">{n}</a></li>' for n in names) + "</ul>"
        return self.pick([" ", " | ", "<br>", " &raquo; "]).join(f'<a href="#">{n}</a>' for n in names)

    def paragraphs(self, low: int, high: int) -> str:
        return "".join(f"<p>{self.inline(self.sentences(1, 4))}</p>" for _ in range(self.rng.randint(low, high)))

    def head_of(self, kind: str) -> str:
        return self.wrap(self.pick(["h2", "h3", "h4", "div", "p", "strong", "span"]), self.pick(PHRASES[kind]))

    def menu(self) -> str:
        return self.wrap(self.pick(MENUS), self.links(2, 9))

    def header(self) -> str:
        inner = self.wrap(self.pick(["h1", "h2", "div", "a", "p", "span"]), self.pick(PHRASES["header"] + [self.words(1, 3)]))
        inner += self.pick(["", f"<p>{self.words(2, 8)}</p>", self.menu(), self.links()])
        return self.wrap(self.pick(HEADERS), inner)

    def footer(self) -> str:
        text = self.pick(["&copy; ", "&copy; 2024 ", "Copyright ", ""]) + self.words(1, 4) + self.pick([" &middot; ", ". ", " | "]) + self.pick(PHRASES["footer"] + [self.sentences(1, 2)])
        return self.wrap(self.pick(FOOTERS), self.pick([text, f"<p>{text}</p>", self.links(2, 6, "footer") + f"<p>{text}</p>", f"<div>{text}</div>{self.links(2, 4, 'footer')}"]))

    def side(self) -> str:
        inner = self.head_of("side") + self.pick([self.links(3, 8), self.paragraphs(1, 3), f"<p>{self.words(5, 20)}</p>", self.links(2, 4) + self.paragraphs(1, 1)])
        return self.wrap(self.pick(SIDES), inner)

    def notice(self) -> str:
        text = self.pick(PHRASES["notice"] + [self.sentences(1, 3)])
        return self.wrap(self.pick(NOTICES), self.pick([text, f"<p>{text}</p>", f"<p>{text}</p><button>{self.pick(PHRASES['notice'])}</button>"]))

    def advert(self) -> str:
        text = self.pick(PHRASES["advert"] + [self.sentences(1, 3)] * 6)
        return self.wrap(self.pick(ADVERTS), self.pick([text, f"<p>{text}</p>", f'<a href="#">{text}</a>', f"<span>Advertisement</span><p>{text}</p>"]))

    def form(self) -> str:
        p = PHRASES["form"]
        field = f"<label>{self.pick(p)}</label><input name=q>" + self.pick(["", "<select><option>One<option>Two</select>", "<textarea>x</textarea>"])
        inner = self.pick(["", f"<p>{self.pick(p)}</p>", f"<h3>{self.pick(p)}</h3>", f"<p>{self.sentences(1, 2)}</p>"]) + field + f"<button>{self.pick(p)}</button>"
        form = self.pick(FORMS)
        return self.wrap(form, inner if form.startswith("form") else f"<form>{inner}</form>")

    def comments(self) -> str:
        one = self.pick(["div class=comment", "article class=comment", "li class=comment", "div class=comment-body", "div", "article", "li", "p"])
        items = ""
        for _ in range(self.rng.randint(1, 5)):
            body = self.sentences(1, 4) if one == "p" else self.pick([f"<b>{self.words(1, 2)}</b>", f"<span class=author>{self.words(1, 2)}</span>", ""]) + self.paragraphs(1, 2) + self.pick(["", '<a href="#">Reply</a>'])
            items += self.wrap(one, body)
        return self.wrap(self.pick(COMMENTS), self.pick(["", self.head_of("comments")]) + items + self.pick(["", self.form()]))

    def share(self) -> str:
        return self.wrap(self.pick(SHARES), self.links(2, 5, "share"))

    def body(self, title: str) -> str:
        """The main text's elements, with what else articles have among them."""
        roll, gold, out = self.rng.random, " data-gold", []
        if roll() < 0.8:
            h1 = self.wrap("h1", title, gold)
            out.append(self.pick([h1] * 5 + [f"<header>{h1}</header>"]))
        if roll() < 0.2:
            out.append(self.wrap(self.pick(["p class=byline", "div class=meta", "time"]), f"{self.words(1, 3)} 12.03.2024", gold))
        for _ in range(self.rng.randint(1, 14)):
            kind = roll()
            if kind < 0.72:
                out.append(f"<p{gold}>{self.inline(self.sentences(1, 7) if roll() < 0.75 else self.words(1, 4).capitalize() + '.')}" + ("</p>" if roll() < 0.85 else ""))
            elif kind < 0.8:
                out.append(self.wrap(self.pick(["h2", "h3"]), self.words(1, 7), gold))
            elif kind < 0.84:
                out.append(self.wrap(self.pick(["ul", "ol"]), "".join(f"<li{gold}>{self.inline(self.sentences(1, 1))}</li>" for _ in range(3))))
            elif kind < 0.87:
                out.append(f"<blockquote{gold}>{self.pick([self.sentences(1, 3), '<p>' + self.sentences(1, 3) + '</p>'])}</blockquote>")
            elif kind < 0.89:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td{gold}>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.91:
                out.append(self.wrap(self.pick(["pre", "div", "figcaption", "section"]), self.sentences(1, 3), gold))
            else:
                out.append(self.pick([self.advert, self.share, self.side, self.form, self.notice, self.menu])())
        return "".join(out)

    def html(self) -> str:
        roll, title = self.rng.random, self.words(2, 10).capitalize()
        main = self.body(title)
        kind = self.pick(MAIN)
        if roll() < 0.06:  # text without elements of its own
            main = self.wrap(self.pick([kind, "div", "section"]), self.pick(["<br>", "<br><br>", " "]).join(self.sentences(1, 4) for _ in range(3)), " data-gold")
        if roll() < 0.2:
            main = self.wrap(self.pick(["div class=inner", "div", "section", "div class=entry"]), main)
        inside = self.pick([self.comments, self.share, self.side, self.footer])() if roll() < 0.3 else ""
        main = self.wrap(kind, main + inside)
        before = [self.pick([self.menu, self.header, self.notice, self.advert, self.form])() for _ in range(self.rng.randint(0, 4))]
        after = [self.pick([self.comments, self.side, self.advert, self.share, self.form, self.notice, self.menu])() for _ in range(self.rng.randint(0, 4))]
        middle = "".join(before) + main + "".join(after)
        if roll() < 0.08:
            middle = f"<table><tr><td>{self.side()}</td><td>{main}</td></tr></table>"
        for _ in range(self.rng.randint(0, 2)):
            middle = self.wrap(self.pick(WRAPPERS), middle)
        page = (self.header() if roll() < 0.4 else "") + middle + (self.footer() if roll() < 0.8 else "")
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{page}" + ("</body></html>" if roll() < 0.9 else "")


def labelled_pages(n: int, seed: int) -> list[str]:
    return [_Page(seed * 1_000_003 + k).html() for k in range(n)]
