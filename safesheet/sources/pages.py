"""Facts of chemical pages: names, registry number, sections under headings, hazard words, rating numbers."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

# Headings of each section, labels of a line of synonyms, hazard words, numbers of a rating, form of a registry number.
SECTIONS = {
    "hazard_summary": ["Hazard Summary", "Hazards", "Overview"], "health_hazard": ["Health Hazard", "Health Effects", "Health"],
    "fire_hazard": ["Fire Hazard", "Fire", "Flammability"], "reactivity_hazard": ["Reactivity", "Stability", "Incompatibility"],
}
SYNONYM_LABELS = ["Other names:", "Synonyms:", "Also known as"]
HAZARD_WORDS = [
    "Flammable", "Explosive", "Oxidizer", "Toxic", "Corrosive", "Irritant", "Sensitizer", "Carcinogenic", "Mutagen", "Reproductive", "Target Organ", "Hazardous to Environment",
    "Acute Toxicity", "Chronic Toxicity", "Eye Damage",
]
RATINGS = ["Health", "Flammability", "Instability", "Reactivity", "Special"]
NUMBER = r"\d{1,7}-\d{1,2}-\d"
# Synonyms at most and their length; paragraphs of a section at most, the least length of one, the greatest of a section.
SYNONYMS, SYNONYM_LENGTH, PARAGRAPHS, LEAST_PARAGRAPH, SECTION_LENGTH = 5, (2, 100), 3, 10, 500
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", "div", "li", "td")
#: Tags without content, and those that end when another of their kind begins.
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
SELF_ENDING = ("p", "li", "td", "tr", "dd", "dt", "option", *HEADINGS)


@dataclass
class Element:
    tag: str
    parent: int
    texts: list[str] = field(default_factory=list)

    def text(self) -> str:
        return "".join(map(str.strip, self.texts))


class Page(HTMLParser):
    """Elements in the order of their begin, each with all text below it, and the text of the whole; scripts and styles have none. Open tags are a stack."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements, self.stack, self.whole = [Element("", -1)], [0], []

    def handle_starttag(self, tag, attrs):
        if tag in SELF_ENDING and self.elements[self.stack[-1]].tag == tag:
            self.stack.pop()
        self.elements.append(Element(tag, self.stack[-1]))
        if tag not in EMPTY:
            self.stack.append(len(self.elements) - 1)

    def handle_startendtag(self, tag, attrs):
        self.elements.append(Element(tag, self.stack[-1]))

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.stack) - 1, 0, -1) if self.elements[self.stack[k]].tag == tag), None)
        if at is not None:
            del self.stack[at:]

    def handle_data(self, data):
        if self.elements[self.stack[-1]].tag in ("script", "style"):
            return
        self.whole.append(data)
        for k in self.stack:
            self.elements[k].texts.append(data)

    def section(self, names: list[str]) -> str:
        """The first paragraphs between a heading that holds one of ``names`` and the next one beside it; of several headings the first with a paragraph."""
        for k, head in enumerate(self.elements):
            if head.tag not in HEADINGS or not any(n.lower() in head.text().lower() for n in names):
                continue
            found: list[str] = []
            for e in self.elements[k + 1 :]:
                if e.parent != head.parent:
                    continue
                if e.tag in HEADINGS or len(found) == PARAGRAPHS:
                    break
                if e.tag in BLOCKS and len(e.text()) > LEAST_PARAGRAPH:
                    found.append(e.text())
            if found:
                return "\n".join(found)[:SECTION_LENGTH]
        return ""


def synonyms(text: str) -> list[str]:
    """Names after the last label of the first line that has a label and a name of the right length."""
    for line in text.split("\n"):
        at = max((line.rfind(x) + len(x) for x in SYNONYM_LABELS if x in line), default=-1)
        if at >= 0:
            names = [n.strip() for n in re.split("[,;]", line[at:])]
            if good := [n for n in names if SYNONYM_LENGTH[0] < len(n) < SYNONYM_LENGTH[1]]:
                return good[:SYNONYMS]
    return []


def read_page(html: str | None) -> dict:
    page = Page()
    page.feed(html or "")
    page.close()
    text = "".join(page.whole)
    title = next((e.text() for e in page.elements if e.tag == "h1"), None) or next((e.text() for e in page.elements if e.tag == "title"), None)
    return {"name": title, "text": text, "synonyms": synonyms(text), **{name: page.section(heads) for name, heads in SECTIONS.items()}}


SHAPE = "name string, text string, synonyms array<string>, " + ", ".join(f"{s} string" for s in SECTIONS)


def page_facts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(``key``, name, cas, synonyms, the columns of SECTIONS, hazards, nfpa) of chemical pages (``key``, html).

    name is the first h1, else the title; cas the first number in the form of a registry number; hazards the hazard words that the text has, in any case, in their
    order; nfpa a map of the ratings found. What isn't there is null or empty; so is all of a null page."""
    read = F.udf(read_page, f"struct<{SHAPE.replace(' ', ':').replace(',:', ',')}>", useArrow=True)
    rows = pages.select(key, read("html").alias("p")).select(key, "p.*")
    rating = lambda name: F.nullif(F.regexp_extract("text", rf"(?i){name}\s*[:=]?\s*([0-9])", 1), F.lit(""))
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(r.lower()).alias("k"), rating(r).cast("int").alias("v")) for r in RATINGS]), lambda x: x["v"].isNotNull()))
    hazards = F.filter(F.array(*map(F.lit, HAZARD_WORDS)), lambda w: F.contains(F.lower("text"), F.lower(w)))
    cas = F.nullif(F.regexp_extract("text", f"({NUMBER})", 1), F.lit(""))
    return rows.select(key, "name", cas.alias("cas"), "synonyms", *SECTIONS, hazards.alias("hazards"), pairs.alias("nfpa"))
