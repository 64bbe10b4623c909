"""Cleaning and cutting of filings in plain Python, one document at a time: what the column expressions are held against."""

import html
import re
from html.parser import HTMLParser

from filingmill.functions.html import BOUNDARIES, FORM_SECTIONS, HEADINGS, MIN_WORDS, NEAR, PAGE_TAGS

ANY = re.IGNORECASE | re.MULTILINE


class Texts(HTMLParser):
    """Text nodes outside scripts, styles and, if asked, tables."""

    def __init__(self, strip_tables):
        super().__init__(convert_charrefs=True)
        self.skip = {"script", "style"} | ({"table"} if strip_tables else set())
        self.inside, self.nodes, self.going_on = [], [], False

    def handle_starttag(self, tag, attrs):
        self.going_on = False
        if tag in self.skip:
            self.inside.append(tag)

    def handle_comment(self, data):
        self.going_on = False

    def handle_endtag(self, tag):
        self.going_on = False
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.inside:
            if self.going_on:  # a lone < comes as data of its own
                self.nodes[-1] += data
            else:
                self.nodes.append(data)
            self.going_on = True


def clean_text(raw, strip_tables=True):
    if not raw or not raw.strip():
        return ""
    text = raw
    if len(re.findall(rf"<(?:{'|'.join(PAGE_TAGS)})\b", raw[:5000], re.IGNORECASE)) >= 2:
        parser = Texts(strip_tables)
        parser.feed(raw)
        parser.close()
        text = "\n".join(parser.nodes)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", html.unescape(text)))
    text = "\n".join(map(str.strip, text.split("\n")))
    for line in (r"^\s*Table\s+of\s+Contents\s*$", r"^\s*-\s*\d+\s*-\s*$", r"^\s*Page\s+\d+\s+of\s+\d+\s*$"):
        text = re.sub(line, "", text, flags=ANY)
    return text.replace("\f", "\n").strip()


def sections_of(text, form_type, least=MIN_WORDS):
    out = []
    for name in FORM_SECTIONS.get(form_type, ()):
        begin = next((m.end() for p in HEADINGS[name] if (m := re.search(p, text, ANY))), None)
        if begin is None:
            continue
        places = [m.start() for p in BOUNDARIES if (m := re.compile(p, ANY).search(text, begin))]
        end = min((x for x in places if x - begin > NEAR), default=len(text))
        body = text[begin:end].strip()
        if len(body.split()) >= least:
            body = re.sub(r"\n{3,}", "\n\n", body)
            out.append((name, body, len(body.split())))
    return out
