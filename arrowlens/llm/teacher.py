"""Labelling functions: the form of a document from its lines, careful and slow, to label a training sample.

Every line is given a form and the form with most characters wins. Only the fitting of the rule list uses this.
"""

from __future__ import annotations

import re
import unicodedata

_MARK = re.compile(r"^\s*(?:[-*+•–—◦▪‣·]\s+|\[[ xX]\]\s|#?\d{1,3}[.):]?\s+(?=\S)|#\d+\s|\(?[a-zA-Z\d]{1,2}[.)]\s|[ivxIVX]{1,4}[.)]\s)")
_BORDER = re.compile(r"^\s*[+|:=\-\s]{3,}\s*$")
_HTML = re.compile(r"</?(?:table|tr|td|th|tbody|thead)\b", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzбвгджзйклмнпрстфхцчшщ]{5,}")
_VOWEL = re.compile(r"[^bcdfghjklmnpqrstvwxzбвгджзйклмнпрстфхцчшщ]")
_LATIN = re.compile(r"[a-zа-я]")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[?\ufffd€¿¤]+(?=[^\W\d_])|\ufffd|[ÂÃâ][?\ufffd€¿ÂÃâ]")
_END = re.compile(r"[.!?:;…。！？\"”)]\s*$")


def _table(line: str) -> bool:
    s = line.strip()
    if _HTML.search(s) or ("+" in s or "|" in s) and _BORDER.match(s):
        return True
    if s.count("|") >= 2 or line.count("\t") >= 1 and len(re.findall(r"[^\t]+", line)) <= 3 * (line.count("\t") + 1) and all(len(c.split()) <= 3 for c in line.split("\t")):
        return True
    for sep in ";,":
        cells = s.split(sep)
        if len(cells) >= 3 and not re.search(sep + r"\s", s) and all(len(c.split()) <= 2 for c in cells):
            return True
    cells = re.split(r" {2,}", s)
    return len(cells) >= 2 and all(len(c.split()) == 1 for c in cells)


def _inline(s: str) -> bool:
    """A list within one line: many short items between commas or semicolons."""
    s = re.sub(r"^[^:,;]{1,30}:\s", "", s)
    for sep in (";", ",", " / ", " | "):
        cells = [c for c in s.split(sep) if c.strip()]
        if len(cells) >= 5 and sum(len(c.split()) <= 4 for c in cells) >= 0.9 * len(cells):
            return True
    return False


def _junk(s: str) -> bool:
    """Nothing readable, by signs that hold in any language: what words look like, not which words they are."""
    body = re.sub(r"\s", "", s)
    if not body:
        return False
    letters = sum(unicodedata.category(c)[0] in "LM" for c in body)
    if letters < 0.35 * len(body) or len(_BROKEN.findall(s)) > 0.02 * len(body):
        return True
    if len(_UNSPACED.findall(body)) > 0.25 * len(body):
        return False
    tokens = s.split()
    words = [w.lower() for w in _WORD.findall(s)]
    if len(body) > 40 and len(tokens) < len(body) / 30:
        return True
    if len(tokens) >= 10 and all(re.fullmatch(r"[0-9a-fA-F]{2}", t) for t in tokens):
        return True
    if len(words) >= 8 and len(set(words)) <= 3:
        return True
    if len(words) < 5:
        return False
    share = lambda n: n / len(words)
    clusters, hollow = share(sum(bool(_CLUSTER.search(w)) for w in words)), share(sum(len(w) >= 3 and not _VOWEL.search(w) and bool(_LATIN.match(w)) for w in words))
    single, gaps = share(sum(len(w) == 1 for w in words)), share(len(re.findall(r"\S {2,}(?=\S)", s)))
    signs = (clusters >= 0.1) + (hollow >= 0.06) + (single >= 0.13) + (gaps >= 0.04)
    return signs >= 2


def form_of(text: str) -> str:
    """prose, list, table or junk; text is not blank."""
    from collections import Counter

    weight: Counter[str] = Counter()
    lines = [x for x in re.split(r"[\n\r\x0b\x0c\x85  ]", text) if x.strip()]
    n_table = sum(_table(x) for x in lines)
    short = [not _END.search(x) and len(x.split()) <= 6 or bool(_MARK.match(x)) for x in lines]
    paragraph: list[str] = []

    def flush() -> None:
        if paragraph:
            block = " ".join(paragraph)
            weight["junk" if _junk(block) else "prose"] += len(block)
            paragraph.clear()

    for x, s in zip(lines, short):
        if _table(x) and (n_table >= 2 or _HTML.search(x)):
            flush()
            weight["table"] += len(x)
        elif _inline(x.strip()) and sum(c.isalpha() for c in x) > 0.5 * len(x):
            flush()
            weight["list"] += len(x)
        elif s and sum(short) >= 3 and not (_junk(x) and not _MARK.match(x)):
            flush()
            weight["list"] += len(x)
        else:
            paragraph.append(x)
    flush()
    return weight.most_common(1)[0][0] if weight else "junk"
