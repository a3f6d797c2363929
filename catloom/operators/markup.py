"""Fields of repeated elements in HTML pages, in one streaming pass over parser events."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements without an end tag, and those whose text nobody sees.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))
#: End tags of these never close another element on the way.
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strike strong sub sup u".split())
ROWS_AT_ONCE = 4096
#: Plainly written tags; a page of no others is read by this pattern, any other by the parser.
PLAIN = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z][-a-zA-Z0-9]*="[^"<>&]*")*)>')
#: The end of a tag and the text behind it. Without texts, pages of one template are equal.
BEHIND = re.compile(r">[^<]+")
PLAIN_ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9]*)="([^"]*)"')
#: Elements whose content the parser reads by other rules: the first two hold plain text if it has no "<", the others do not.
SCRIPTS, SPECIAL = frozenset(("script", "style")), frozenset("textarea title iframe noembed noframes noscript xmp plaintext svg math".split())
KNOWN_TAGS = 4096
#: Characters of all templates that a reader keeps, and of one.
TEMPLATE_CHARS, LONGEST_TEMPLATE = 1 << 22, 1 << 16


@dataclass(frozen=True)
class Mark:
    """An element by its tag, its id, whole class names, and fragments that occur in its class attribute."""

    tag: str
    classes: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    id: str | None = None

    def fits(self, tag: str, attributes: dict[str, str | None]) -> bool:
        if tag != self.tag or (self.id is not None and attributes.get("id") != self.id):
            return False
        style = attributes.get("class") or ""
        return all(p in style for p in self.parts) and (not self.classes or set(self.classes) <= set(style.split()))


@dataclass(frozen=True)
class Field:
    """The first element in a card at the end of ``path`` (ancestors first); its text, or one of its attributes."""

    name: str
    path: tuple[Mark, ...]
    attribute: str | None = None


class _Open:
    __slots__ = ("attributes", "card", "fits", "tag", "texts")

    def __init__(self, tag: str, attributes: dict[str, str | None], fits: frozenset[Mark]):
        self.tag, self.attributes, self.fits, self.card, self.texts = tag, attributes, fits, None, []


class CardReader(HTMLParser):
    """Collects the fields of every card inside the container (None: anywhere); a card in a card has its own."""

    def __init__(self, card: Mark, fields: Sequence[Field], container: Mark | None = None):
        super().__init__()
        self.card, self.fields, self.container = card, fields, container
        self.marks = {card, *(m for f in fields for m in f.path), *([container] if container else [])}
        self.known: dict[tuple[str, str], tuple[str, dict, frozenset[Mark]]] = {}  # start tags as written
        self.templates: dict[str, list[list] | None] = {}  # what the cards of a page of these tags hold
        self.kept = 0
        self.open: list[_Open] = []
        self.cards: list[dict[str, str | list | None]] = []

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        self._start(tag, attributes, self._fitting(tag, attributes))

    def _fitting(self, tag: str, attributes: dict[str, str | None]) -> frozenset[Mark]:
        return frozenset(m for m in self.marks if m.fits(tag, attributes))

    def _start(self, tag: str, attributes: dict[str, str | None], fits: frozenset[Mark]) -> None:
        if tag == "li":  # a new item ends the one before, unless a list begins in between
            for place in range(len(self.open) - 1, -1, -1):
                if self.open[place].tag in ("ul", "ol"):
                    break
                if self.open[place].tag == "li":
                    del self.open[place:]
                    break
        element = _Open(tag, attributes, fits)
        inside = self.card in fits and (self.container is None or any(self.container in o.fits for o in self.open))
        self.open.append(element)
        if inside:
            element.card = {}
            self.cards.append(element.card)
        if fits:
            start = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].card is not None), None)
            if start is not None:
                self._begin_fields(element, self.open[start].card, self.open[start:-1])
        if tag in VOID:
            self.open.pop()

    def _begin_fields(self, element: _Open, card: dict, above: list[_Open]) -> None:
        for field in self.fields:
            if field.name in card or field.path[-1] not in element.fits:
                continue
            ancestors = iter(above)
            if all(any(mark in o.fits for o in ancestors) for mark in field.path[:-1]):
                if field.attribute is not None:
                    card[field.name] = element.attributes.get(field.attribute)
                else:
                    card[field.name] = parts = []
                    element.texts.append(parts)

    def handle_endtag(self, tag):
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place].tag == tag:
                del self.open[place:]
                return
            if tag in INLINE and self.open[place].tag not in INLINE:
                return

    def handle_data(self, data):
        if any(o.tag in HIDDEN for o in self.open):
            return
        for element in self.open:
            for parts in element.texts:
                parts.append(data)

    def _template(self, tags: str) -> list[list] | None:
        """The fields of the cards of a page of these tags, by the parser's events; None if a tag is not plain.

        A field is an attribute (text or None) or the numbers of the tags whose texts behind them are its own.
        """
        self.open, self.cards = [], []
        at, script = 0, None
        for number, found in enumerate(PLAIN.finditer(tags), 1):
            if found.start() != at:
                return None
            at = found.end()
            closing, name, written = found.groups()
            if closing:
                tag = name.lower()
                if written or (script and tag != script):
                    return None
                script = None
                self.handle_endtag(tag)
            else:
                if script:
                    return None
                known = self.known.get((name, written))
                if known is None:
                    tag, attributes = name.lower(), {k.lower(): v for k, v in PLAIN_ATTRIBUTE.findall(written)}
                    if tag in SPECIAL:
                        return None
                    if len(self.known) >= KNOWN_TAGS:
                        self.known.clear()
                    known = self.known[name, written] = tag, attributes, self._fitting(tag, attributes)
                if known[0] in SCRIPTS:
                    script = known[0]
                self._start(*known)
            self.handle_data(number)
        return [[card.get(f.name) for f in self.fields] for card in self.cards] if at == len(tags) and script is None else None

    def _read_plain(self, page: str) -> list[list[str | None]] | bool:
        """The rows of a page whose tags are plain throughout; false if they are not.

        Which texts go where depends on the tags alone, so pages of one template are followed through once.
        """
        start = page.find("<")
        if start < 0:
            return []
        page = page[start:]
        tags = BEHIND.sub(">", page)
        if tags in self.templates:
            cards = self.templates[tags]
        else:
            cards = self._template(tags)
            if len(tags) <= LONGEST_TEMPLATE:
                if self.kept + len(tags) > TEMPLATE_CHARS:
                    self.templates.clear()
                    self.kept = 0
                self.templates[tags] = cards
                self.kept += len(tags)
        if cards is None:
            return False
        behind = page.split("<") if cards else []  # a tag without its "<" and the text behind it, from number 1
        text = lambda number: unescape(behind[number].partition(">")[2]).strip()
        return [["".join(map(text, v)) if isinstance(v, list) else v for v in values] for values in cards]

    def rows(self, page: str | None) -> list[list[str | None]]:
        """Per card, in page order, the values of the fields; None where a card has no such element."""
        plain = self._read_plain(page or "")
        if plain is not False:
            return plain
        self.reset()
        self.open, self.cards = [], []
        self.feed(page or "")
        self.close()
        out = []
        for card in self.cards:
            values = [card.get(f.name) for f in self.fields]
            out.append(["".join(p.strip() for p in v) if isinstance(v, list) else v for v in values])
        return out


def card_fields(df: DataFrame, key: str, html: str, card: Mark, fields: Sequence[Field], container: Mark | None = None) -> DataFrame:
    """(key, pos, one column per field): a row for each card of each page.

    Text of a field is that of its element and all below, white space trimmed around each piece, without scripts and styles. End
    tags that match nothing are ignored and crossed ones close what they opened, so broken pages lose no card. A page
    is read in one pass, and pages with the same tags are followed through once; at most ``ROWS_AT_ONCE`` cards are held besides the batch. Null pages have no cards.
    """
    kind = df.schema[key].dataType.simpleString()
    columns = ", ".join(f"f{i} string" for i in range(len(fields)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = CardReader(card, fields, container)
        for batch in batches:
            held: list[tuple] = []
            for row, page in enumerate(batch.column(1)):
                held += [(row, pos, values) for pos, values in enumerate(reader.rows(page.as_py()))]
                if len(held) >= ROWS_AT_ONCE or row == batch.num_rows - 1:
                    rows, places, values = zip(*held, strict=True) if held else ((), (), ())
                    arrays = [pa.array([v[i] for v in values], pa.string()) for i in range(len(fields))]
                    keys = batch.column(0).take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(places, pa.int32()), *arrays], names=["_key", "pos", *[f"f{i}" for i in range(len(fields))]])
                    held = []

    rows = df.select(F.col(key).alias("_key"), F.col(html).alias("_html")).mapInArrow(read, f"_key {kind}, pos int, {columns}")
    return rows.select(F.col("_key").alias(key), "pos", *[F.col(f"f{i}").alias(f.name) for i, f in enumerate(fields)])
