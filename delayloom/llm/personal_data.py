"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby raise or lower their score."""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which spans with the same start come.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"

_LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile("[0-9]")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?(?:\[at\]|\(at\)) ?", re.IGNORECASE)
_SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)) ?|\.)[A-Za-z0-9-]++)++", re.IGNORECASE)
_IPV6 = re.compile(r":[0-9A-Fa-f:]++")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NATIONAL = re.compile(r"\(?[0-9]{2,5}\)?[ ./-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}")
_GROUPS = re.compile("[0-9]+")
#: Usual groupings of card numbers.
_SHAPES = ((19,), (4, 4, 4, 4, 3), (16,), (4, 4, 4, 4), (15,), (4, 6, 5), (14,), (4, 6, 4), (13,))

#: Words that speak for a kind, and words that speak for some other number.
FOR = {
    "email": "mail email e-mail contact write courriel correo", "ip": "ip address addr host server adresse dirección", "card": "card credit debit visa mastercard amex payment carte karte kreditkarte tarjeta",
    "phone": "phone tel telephone telefon téléphone teléfono tél fax call mobile cell whatsapp handy portable móvil appeler", "iban": "iban bank account konto compte cuenta", "ssn": "ssn social security",
}
AGAINST = "order invoice isbn issn version build part serial sku ticket tracking page pages edition article ref reference rechnung facture pedido"
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_SPEAKS = {kind: frozenset(words.split()) for kind, words in FOR.items()}
_DENIES = frozenset(AGAINST.split())
#: Code points before and after a span in which words count, what they add or take, and the score from which a span is kept.
BEFORE, AFTER, ADDS, TAKES, LEAST = 40, 20, 0.3, 0.3, 0.5


def luhn(digits: str) -> bool:
    """Whether the check digit, the last one, fits."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(map(int, "".join(str(2 * int(d)) for d in even)))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether the check digits, third and fourth, fit the account number."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of the four base patterns, each kind for itself, that pass their checks: (start, end, kind).

    Each pattern is searched in time linear in the text: an address is looked
    for from its @, and runs of digits are never entered in their middle.
    """
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        name = len(before) - len(before.rstrip(_LOCAL_PART))
        domain = _DOMAIN.match(text, at + 1) if name else None
        done = domain.end() if domain else at + 1
        if domain:
            found.append((at - name, done, "email"))
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return found
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k : k + 4])) + 3
            if all(map(_small, parts[k : k + 4])):
                found.append((at, end, "ip"))
            at = end + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), "phone"))
    return found


def _apart(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit touches the span."""
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def proposed_spans(text: str) -> list[tuple[int, int, str, float]]:
    """Further spans with the score of their form alone: (start, end, kind, score).

    Addresses spelt with [at] and [dot]; cards by usual grouping within longer
    chains of digits, confirmed by Luhn; account numbers confirmed by mod 97;
    IPv6 addresses; phone numbers without country code; social security numbers.
    """
    out = []
    for m in _AT.finditer(text) if "at]" in (low := text.lower()) or "at)" in low else ():
        before = text[max(0, m.start() - 64) : m.start()]
        name = len(before) - len(before.rstrip(_LOCAL_PART))
        if name and (domain := _SPELT_DOMAIN.match(text, m.end())):
            out.append((m.start() - name, domain.end(), "email", 0.7))
    if not _DIGIT.search(text):
        return out
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        groups = [g.span() for g in _GROUPS.finditer(text, *m.span())]
        k = 0
        while k < len(groups):
            for shape in _SHAPES if groups[k][1] - groups[k][0] >= 4 else ():
                part = groups[k : k + len(shape)]
                if tuple(b - a for a, b in part) == shape and luhn(digits := "".join(text[a:b] for a, b in part)) and _apart(text, part[0][0], part[-1][1]):
                    known = digits[0] in "3456" and len(digits) > 13
                    out.append((part[0][0], part[-1][1], "card", 0.6 if known else 0.3))
                    k += len(shape) - 1
                    break
            k += 1
    for m in _IBAN.finditer(text):
        ends = [i for i in range(m.end(), m.start() + 14, -1) if text[i - 1] != " " and not (i < len(text) and text[i].isalnum())]
        if not (m.start() and text[m.start() - 1].isalnum()):
            out += [(m.start(), i, "iban", 0.8) for i in ends if 15 <= len(a := text[m.start() : i].replace(" ", "")) <= 34 and mod97(a)][:1]
    if ":" in text:
        for m in _IPV6.finditer(text):
            before = text[max(0, m.start() - 5) : m.start()]
            start = m.start() - len(before) + len(before.rstrip("0123456789abcdefABCDEF"))
            end = m.end() - (text[m.end() - 1] == ":" and text[m.end() - 2] != ":")
            value = text[start:end] if end - start <= 39 else ""
            if value.count(":") >= 2 and sum(map(bool, value.split(":"))) >= 3 and _DIGIT.search(value) and _apart(text, start, end):
                try:
                    ipaddress.IPv6Address(value)
                except ValueError:
                    continue
                out.append((start, end, "ip", 0.6))
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and _apart(text, *m.span()) and text[m.end() : m.end() + 1] != "-" and (not m.start() or text[m.start() - 1] != "-"):
            out.append((*m.span(), "ssn", 0.5))
    for m in _NATIONAL.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if 9 <= digits <= 11 and _apart(text, *m.span()) and ("(" in m[0]) == (")" in m[0]):
            out.append((*m.span(), "phone", 0.5 if re.fullmatch(r"\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}", m[0]) else 0.3))
    return out


def _context(text: str, start: int, end: int, kind: str) -> float:
    words = {w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER])}
    return ADDS * bool(words & _SPEAKS[kind]) - TAKES * bool(words & _DENIES)


def find_spans(text: str | None) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) of all spans of a text, by start, kind and end; places are code points, ends exclusive.

    Base spans stay whatever their score; a further one stays if its score
    reaches ``LEAST``, it touches no base span and no further one of higher score.
    """
    if not text:
        return []
    scored = lambda form, a, b, kind: round(min(1.0, max(0.0, form + _context(text, a, b, kind))), 2)
    base = base_spans(text)
    found = [(kind, a, b, True, scored(0.8, a, b, kind)) for a, b, kind in base]
    more = [(-s, a, b, kind) for a, b, kind, form in proposed_spans(text) if (s := scored(form, a, b, kind)) >= LEAST]
    taken = _Taken((a, b) for a, b, _ in base)
    for less, a, b, kind in sorted(more, key=lambda x: (x[0], x[1] - x[2], x[1])):
        if taken.add(a, b):
            found.append((kind, a, b, False, -less))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


class _Taken:
    """Which places spans hold, kept by blocks of 64 so that a test costs as much as the span is long."""

    def __init__(self, spans):
        self.blocks: dict[int, int] = {}
        for a, b in spans:
            for k, mask in self._masks(a, b):
                self.blocks[k] = self.blocks.get(k, 0) | mask

    @staticmethod
    def _masks(a: int, b: int):
        for k in range(a // 64, (b - 1) // 64 + 1):
            low, high = max(a, 64 * k), min(b, 64 * k + 64)
            yield k, ((1 << (high - low)) - 1) << (low - 64 * k)

    def add(self, a: int, b: int) -> bool:
        """Takes the places if all of them are free."""
        masks = list(self._masks(a, b))
        if any(self.blocks.get(k, 0) & mask for k, mask in masks):
            return False
        for k, mask in masks:
            self.blocks[k] = self.blocks.get(k, 0) | mask
        return True


def masked(text: str | None, spans: list[tuple[str, int, int, bool, float]]) -> str | None:
    """``text`` with each span, or spans that overlap together, replaced by the first one's kind in angle brackets."""
    if text is None:
        return None
    parts, done = [], 0
    for kind, a, b, *_ in spans:
        if a >= done:
            parts += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(parts) + text[done:]


def personal_data(documents: DataFrame, mask: bool = False) -> DataFrame:
    """doc_id and spans of every row of ``documents(doc_id, text)``; with ``mask`` also ``masked``, the text without them.

    A span has its kind, its place in code points (end exclusive), whether it
    is one of the base patterns, and a score: that of its form, raised by words
    nearby that name the kind and lowered by words that name other numbers.

    Rows are independent: none leaves its task, and a lost executor costs its
    own rows again. Null and empty texts have no spans (masked: null and
    empty). Null ids and repeated rows are rows like any other; extra columns
    are left behind; an empty table gives no row.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
    names = ("kind", "start", "end", "base", "score")

    def local(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = [find_spans(t) for t in texts]
            columns = [b.column(0), pa.array([[dict(zip(names, s, strict=True)) for s in own] for own in spans], kind)]
            if mask:
                columns.append(pa.array([masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", *["masked"] * mask])

    of = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", documents["text"].cast("string")).mapInArrow(local, f"doc_id {of}, spans {SPANS}" + ", masked string" * mask)
