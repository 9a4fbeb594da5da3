"""Small independent models of the chunkers, written against their description."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET


def tok(s):
    return len(s) // 4 + 1


def normal(s):
    return re.sub(r"\r\n?", "\n", s)


def windows(s, cs):
    w = 4 * cs - 1
    return [(s[i : i + w], tok(s[i : i + w])) for i in range(0, len(s), w)]


def pack(items, cs, sizes=None):
    """[(kind, [items], size)]: runs within the size, oversize items alone."""
    out, run, size = [], [], 0
    for it in items:
        k = tok(it)
        if k > cs:
            if run:
                out.append(("run", run, size))
            out.append(("solo", [it], k))
            run, size = [], 0
        elif run and size + k > cs:
            out.append(("run", run, size))
            run, size = [it], k
        else:
            run, size = run + [it], size + k
    if run:
        out.append(("run", run, size))
    return out


def text_chunks(text, cs):
    out = []
    for kind, items, size in pack(normal(text).splitlines(keepends=True), cs):
        out += windows(items[0], cs) if kind == "solo" else [("".join(items), size)]
    return out


def valid(x):
    try:
        ET.fromstring(x)
        return True
    except ET.ParseError:
        return False


def scan(x):
    """Yield (kind, start, end) by explicit index walking."""
    i = 0
    while i < len(x):
        if x[i] != "<":
            j = x.find("<", i)
            j = len(x) if j < 0 else j
            yield "text", i, j
            i = j
            continue
        for head, tail in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>")):
            if x.startswith(head, i) and x.find(tail, i) >= 0:
                j = x.find(tail, i) + len(tail)
                yield "skip", i, j
                break
        else:
            j = x.find(">", i)
            if j < 0:
                yield "rest", i, len(x)
                return
            j += 1
            tag = x[i:j]
            yield "close" if tag.startswith("</") else "self" if tag.endswith("/>") else "open", i, j
        i = j


def xml_normal(x):
    if valid(x):
        return x
    out, depth = "", 0
    for kind, a, b in scan(x):
        s = x[a:b]
        if kind in ("text", "rest"):
            if depth == 0:
                if s.strip():
                    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
                        s = s.replace(c, e)
                s = f"<p>{s}</p>"
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        out += s
    return out if valid(out) else f"<x>{out}</x>"


def xml_spans(x):
    out, depth, start = [], 0, None
    for kind, a, b in scan(x):
        if kind == "rest":
            break
        if kind == "text" and depth == 0:
            out.append((a, b))
        elif kind == "self" and depth == 0:
            out.append((a, b))
        elif kind == "open":
            if depth == 0:
                start = a
            depth += 1
        elif kind == "close":
            depth -= 1
            if depth == 0 and start is not None:
                out.append((start, b))
                start = None
    return out


def xml_chunks(text, cs):
    x = xml_normal(normal(text))
    if tok(x) <= cs:
        return [(x, tok(x))]
    spans = xml_spans(x)
    if not spans:
        return text_chunks(x, cs)
    out = []
    for kind, items, _ in pack([x[a:b] for a, b in spans], cs):
        if kind == "solo":
            out += windows(items[0], cs)
        else:
            s = "".join(items)
            s = s if valid(s) else f"<x>{s}</x>"
            out.append((s, tok(s)))
    return out


STARTS = re.compile(
    r"(?:def |function |func |fn |public |private |protected |static |class |struct |interface |enum "
    r"|import |from .* import|include |require |using |namespace |module |package |/\*\*|\*/|###|///)"
)


def line_state(line):
    brace = paren = 0
    quote = None
    for i, ch in enumerate(line):
        escaped = i > 0 and line[i - 1] == "\\"
        if quote:
            if ch == quote and not escaped:
                quote = None
        elif ch in "\"'":
            if not escaped:
                quote = ch
        elif ch in "{}":
            brace += 1 if ch == "{" else -1
        elif ch in "()":
            paren += 1 if ch == "(" else -1
    return brace, paren, quote is not None


def code_chunks(text, cs, stale):
    lines = normal(text).splitlines(keepends=True)
    mark = lambda s: bool(STARTS.match(s)) or not s.strip()
    out, run, size, brace, paren = [], [], 0, 0, 0
    for i, line in enumerate(lines):
        b, p, open_quote = line_state(line)
        brace, paren = max(0, brace + b), max(0, paren + p)
        word = line.strip().startswith(("def ", "class ", "function ", "public ", "private "))
        good = not brace and not paren and not open_quote and (mark(line) or (i > 0 and word))
        k = tok(line)
        if run and size + k > cs:
            at = len(run)
            if not good and len(run) > 10:
                back = [j for j in range(max(0, len(run) - 20) + 1, len(run)) if mark(run[j])]
                at = back[-1] if back else at
            tally = size if at == len(run) else sum(map(tok, run[:at]))
            out.append(("".join(run[:at]), tally))
            run = run[at:] + [line]
            size = sum(map(tok, run))
        else:
            run, size = run + [line], size + k
        if k > cs:
            run = run[:-1]
            if run:
                out.append(("".join(run), size - k))
                size = 0
            elif not stale:
                size = 0
            out += windows(line, cs)
            run = []
    if run:
        out.append(("".join(run), size))
    return out
