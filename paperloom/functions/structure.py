"""Sections, chunks and markdown of single texts (TX1-TX15, ST24, ST29, SC45)."""

from __future__ import annotations

import re

#: Section headers in their usual order, and how far a section reaches without a next one.
SECTIONS = {
    "abstract": (r"abstract|summary", 2000), "introduction": (r"introduction|background", 5000), "methods": (r"methods?|methodology|materials and methods|approach", 10000),
    "results": (r"results?|findings|experiments", 10000), "discussion": (r"discussion|analysis", 10000), "conclusion": (r"conclusions?|concluding remarks|summary and conclusions?", 3000),
}


def sections(text: str) -> dict[str, tuple[int, int]]:
    """TX1, TX2, TX10: start and end of each section; of several conclusions the last one."""
    heads = []
    for name, (pattern, _) in SECTIONS.items():
        found = list(re.finditer(rf"(?im)^[ \t]*(?:#+\s*)?(?:\d+\.?\s*|[IVX]+\.\s*)?(?:{pattern})[ \t]*:?[ \t]*\r?$", text))
        if found:
            heads.append(((found[-1] if name == "conclusion" else found[0]).start(), name))
    heads.sort()
    out = {}
    for i, (start, name) in enumerate(heads):
        end = heads[i + 1][0] if i + 1 < len(heads) else min(len(text), start + SECTIONS[name][1])
        out[name] = (start, end)
    return out


def break_positions(text: str, size: int, overlap: int, start: int = 0) -> list[int]:
    """Ends of the windows that are laid over a text from ``start`` on: at the last full stop or line end of a window,
    where one is in its last 200 characters, else one behind these; the next window begins ``overlap`` before it."""
    out, at = [], start
    while at < len(text):
        end = at + size
        if end < len(text):
            end = max(end - 200, text.rfind(".", at, end), text.rfind("\n", at, end)) + 1
        out.append(min(end, len(text)))
        at = out[-1] if out[-1] == len(text) else max(out[-1] - overlap, at + 1)
    return out


def simple_chunks(text: str, size: int = 15000, overlap: int = 500, least: int = 1000, start: int = 0) -> list[tuple[int, int]]:
    """TX4: (start, end) of sliding chunks; each window but the first begins ``overlap`` before the end of the one before and
    takes as much before it along; chunks of fewer than ``least`` characters are left out, unless the text is one."""
    ends = break_positions(text, size, overlap, start)
    starts = [start, *(e - overlap for e in ends[:-1])][: len(ends)]
    laid = [(max(0, s - overlap) if i or start else s, e) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
    return [(s, e) for s, e in laid if len(text[s:e].strip()) >= least or len(ends) == 1]


def chunks(text: str, size: int = 15000, overlap: int = 500) -> list[tuple[str, int, int]]:
    """TX3, TX4, TX5: (section, start, end); a text up to ``size`` is one chunk.

    Otherwise main sections that fit into one chunk together come first, then what no section of these holds,
    as sliding chunks to the end of the text: nothing of the text is left out."""
    if len(text) <= size:
        return [("whole", 0, len(text))]
    got, main, room = sections(text), [], size
    for name in ("abstract", "introduction", "conclusion"):
        if name in got and got[name][1] - got[name][0] <= room:
            main.append((name, *got[name]))
            room -= got[name][1] - got[name][0]
    if not main:
        return [("part", s, e) for s, e in simple_chunks(text, size, overlap)]
    out, at = list(main), 0
    for _, s, e in [*sorted(main, key=lambda x: x[1]), ("", len(text), len(text))]:
        if text[at:s].strip():
            out.extend(("rest", at + a, at + b) for a, b in simple_chunks(text[at:s], size, overlap, 1))
        at = max(at, e)
    return out


def token_chunks(text: str, max_tokens: int = 1000, overlap: int = 200) -> list[tuple[int, int]]:
    """TX6: windows of four characters a token that end at the last sentence end of their final fifth."""
    size, step, out, at = max_tokens * 4, overlap * 4, [], 0
    if len(text) <= size:
        return [(0, len(text))] if text else []
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            near = [m.end() for m in re.finditer(r"[.!?]\s", text[at + int(size * 0.8) : end])]
            end = at + int(size * 0.8) + near[-1] if near else end
        out.append((at, end))
        if end >= len(text):
            break
        at = max(end - step, at + 1)
    return out


def title_line(text: str) -> str | None:
    """TX7, ST24: the first of 20 lines that can be a title."""
    return next((s for s in (x.strip() for x in text.split("\n")[:20]) if 10 < len(s) < 200 and not s.lower().startswith("http")), None)


def truncated(text: str, most: int) -> str:
    """TX9, TX15: the main sections, then as much of beginning and end as there is room for."""
    if len(text) <= most:
        return text
    got = sections(text)
    keep = "\n\n".join(text[s:e].strip() for n, (s, e) in got.items() if n in ("abstract", "introduction", "conclusion"))
    mark = "\n\n[... omitted ...]\n\n"
    if not keep:
        half = max(0, (most - len(mark)) // 2)
        return text[:half] + mark + text[len(text) - half :]
    if len(keep) >= most:
        return keep[:most]
    half = max(0, (most - len(keep) - 2 * len(mark)) // 2)
    middle = [(s, e) for n, (s, e) in got.items() if n not in ("abstract", "introduction", "conclusion")]
    body = text[middle[0][0] : middle[-1][1]] if middle else text
    return (keep + mark + body[:half] + mark + body[len(body) - half :] if half else keep)[:most]


def markdown_sections(text: str) -> dict[str, str]:
    """TX14: body of each header; of equal headers the last."""
    parts = re.split(r"(?m)^#{2,3}\s+(.+?)\s*$", text)
    return {h.strip(): b.strip() for h, b in zip(parts[1::2], parts[2::2], strict=True)}


def summary_fields(text: str) -> dict[str, str | None]:
    """TX13, SC38: header fields and statistics of a summary file."""
    got = {k: m[1].strip() if (m := re.search(rf"(?im)^\*\*{k}s?:\*\*\s*(.+)$", text)) else None for k in ("Author", "Year", "Source", "Venue", "DOI", "PDF", "Generated")}
    got["Title"] = m[1].strip() if (m := re.search(r"(?m)^#\s+(.+)$", text)) else None
    for k in ("Input", "Output", "Compression", "Quality Score", "Attempts"):
        got[k] = m[1] if (m := re.search(rf"(?i){k}[^:\n]*:\**\s*([\d,.]+)", text)) else None
    return got


#: Openings of lines in which a model talks about its answer, and headers that do not belong there.
META_LINES = r"(?i)^(?:here(?:'s| is)\b.*summary|i (?:have|will|can)\b|let me\b|please note\b|note: this summary\b|as an ai\b|disclaimer\b)"
UNWANTED = r"(?i)^#{2,3}\s+(?:disclaimer|notes?|about this summary|acknowledg)"


def clean_summary(text: str) -> str:
    """ST29: without lines about the answer itself and without unwanted sections."""
    out, skip = [], False
    for line in text.split("\n"):
        if line.startswith("##"):
            skip = bool(re.match(UNWANTED, line))
        if not skip and not re.match(META_LINES, line.strip()):
            out.append(line)
    return "\n".join(out).strip()


def previous_numbers(report: str) -> dict[str, int]:
    """SC45: numbers that an earlier report gives, by their labels."""
    return {k.strip().lower(): int(v.replace(",", "")) for k, v in re.findall(r"(?m)^[-*]?\s*\**([A-Za-z][\w ]+?)\**:\s*\**([\d,]+)", report)}
