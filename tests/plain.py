"""Question rules as plain loops over one paper's rows, to hold the Spark operators against."""

import re

SUB_PART = re.compile(r"^\s*\((?:i{1,3}|iv|v|vi{0,3}|ix|x|xi{0,3}|[a-d])\)\s", re.I)
OPTION_A, OPTION_D = re.compile(r"^\(A\)", re.M), re.compile(r"^\(D\)", re.M)


def words(text):
    flat = re.sub(r"[^a-z0-9_\s]", "", re.sub(r"\s+", " ", text.lower()))
    return {w for w in flat.split() if len(w) > 3}


def share(a, b):
    x, y = words(a), words(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def quality(text, marks=None):
    n = len(text) + (50 if marks is not None and marks > 0 else 0)
    n += 30 if OPTION_A.search(text) and OPTION_D.search(text) else 0
    return n - (40 if text.strip().startswith("...") else 0)


def fragment(text):
    return bool(SUB_PART.match(text.strip()))


def append(base, more):
    base, more = base.rstrip(), more.strip()
    if not base or not more:
        return base or more
    heads = [re.sub(r"\s+", " ", t.lower()).strip()[:120] for t in (base, more)]
    if share(base, more) >= 0.35 or heads[1][:40] in heads[0] or heads[0][:40] in heads[1]:
        return base.strip() if quality(base.strip()) >= quality(more) else more
    return f"{base}\n{more}"


def blocks(text):
    """Blocks by blank lines, before '...', and where a full set of options is followed by a new stem."""
    out = []
    for part in re.split(r"\n(?=\.\.\.)", text.strip()):
        held = []
        for line in part.strip().split("\n"):
            if not line.strip():
                out, held = out + (["\n".join(held)] if held else []), []
                continue
            whole, t = "\n".join(held), line.strip()
            stem = not re.match(r"\([A-D]\)", t) and not re.match(r"\([ivx]+\)", t, re.I) and not t.startswith("...") and re.match(r"[A-Z\"'(]", t) and (t[-1] in "?:" or len(t) > 40)
            if held and OPTION_A.search(whole) and OPTION_D.search(whole) and not re.search(r"\([ivx]+\)", whole, re.I) and (stem or re.match(r"\(a\)\s", t, re.I)):
                out, held = [*out, whole], []
            held.append(line)
        out += ["\n".join(held)] if held else []
    return out


def once(text):
    """A text without stems and options written twice."""
    found = blocks(text) if text.strip() else []
    if len(found) < 2:
        return text.strip()
    kept = []
    for b in found:
        like = next((i for i, k in enumerate(kept) if share(k, b) >= 0.42), None)
        if like is None:
            kept.append(b)
        elif quality(b) > quality(kept[like]):
            kept[like] = b
    if len(kept) == 1:
        return kept[0].strip()
    for k in kept:
        if len(re.findall(r"\([ivx]+\)", k, re.I)) >= 2:
            return k.strip()
    full = [k for k in kept if not k.strip().startswith("...") and OPTION_A.search(k.strip()) and OPTION_D.search(k.strip()) and len(next(x for x in k.strip().split("\n") if x.strip())) > 25]
    if len(full) > 1:
        return min(full, key=text.find).strip()
    return max(kept, key=quality).strip()


def meet(a, b):
    """Two rows (dicts) of a question in order."""
    fa, fb = fragment(a["text"]), fragment(b["text"])
    first = b["marks"] if a["marks"] is None else a["marks"]
    figure = a["figure"] or b["figure"]
    if share(a["text"], b["text"]) >= 0.38 or not (fa or fb):
        best = a if quality(a["text"], a["marks"]) >= quality(b["text"], b["marks"]) else b
        return {**best, "marks": first, "figure": figure}
    if fa and not fb:
        return {**b, "text": append(b["text"], a["text"]), "marks": a["marks"] if b["marks"] is None else b["marks"], "figure": figure}
    text = append(a["text"], b["text"])
    return {**a, "text": once(text) if fa and fb else text, "marks": first, "figure": figure}


def merge(rows):
    """{number: row} of one paper's rows: sub-parts go to the question opened last."""
    held, last = {}, None
    for r in sorted(rows, key=lambda r: r["order"]):
        if not r["text"] or not r["text"].strip():
            continue
        no = last if held and fragment(r["text"]) else r["no"]
        if no in held:
            held[no] = meet(held[no], r)
        else:
            held[no], last = r, no
    return {no: {**r, "no": no, "text": once(r["text"])} for no, r in held.items()}


def bare(text):
    return re.sub(r"^\d{1,2}\.\s+", "", text.strip()).strip()


def split(row):
    """A row cut before embedded numbers; long rows 17 to 28 before lines that start a question too."""
    text = row["text"].strip()
    at = [m.start() for m in re.finditer(r"\n(\d{1,2})\.\s+(?=[A-Z\"(])", text)]
    if at:
        parts = [(row["no"], text[: at[0]])] + [(int(re.match(r"\n(\d+)", text[i:])[1]), text[i:j]) for i, j in zip(at, [*at[1:], len(text)])]
        return [{**row, "no": no, "text": bare(t)} for no, t in parts if len(bare(t)) > 8]
    if len(text) >= 850 and row["no"] is not None and 17 <= row["no"] <= 28:
        lines = text.split("\n")
        hit = [i for i, x in enumerate(lines) if (m := re.match(r"(\d{1,2})\.\s+(.*)$", x.strip())) and 1 <= int(m[1]) <= 40 and not re.match(r"\([a-d]\)|\([ivx]+\)", m[2], re.I)]
        if len(hit) > 1:
            parts = ["\n".join(lines[i:j]) for i, j in zip(hit, [*hit[1:], len(lines)])]
            return [{**row, "no": int(re.match(r"\s*(\d+)", p)[1]), "text": bare(p)} for p in parts if len(bare(p)) > 8]
    return [{**row, "text": text}]


def default_marks(no):
    return next((m for a, b, m in ((1, 16, 1), (17, 21, 2), (22, 28, 3), (29, 30, 4), (31, 33, 5)) if a <= no <= b), None)


def finalize(rows):
    """Merged, cut, merged again by number, usual marks filled in where none are known."""
    held = {}
    parts = [p for r in merge(rows).values() for p in split(r) if p["no"] is not None]
    for p in sorted(parts, key=lambda p: (p["order"], p["text"])):
        held[p["no"]] = meet(held[p["no"]], p) if p["no"] in held else p
    out = {}
    for no, r in held.items():
        given = r["marks"] is not None and r["marks"] > 0
        ruled = default_marks(no)
        out[no] = {**r, "text": once(r["text"]), "marks": r["marks"] if given or ruled is None else float(ruled), "inferred": not given and ruled is not None}
    return out


def continued(text, more):
    """A question's text with its continuations in order."""
    for i, m in enumerate(more):
        text = m.strip() if text is None else once(append(text, m))
    return text or ""


# --- reading -----------------------------------------------------------------

EDGE = re.compile("[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", re.A)
MISREAD = set("§$©¶|~<>^&•`")
DEVANAGARI = re.compile("[\u0900-\u097f]+")


def trim(text):
    return re.sub(f"^{EDGE.pattern}|{EDGE.pattern}$", "", text, flags=re.A)


def english(text):
    clean = "".join(" " if c in MISREAD else c for c in DEVANAGARI.sub(" ", text))
    return "\n".join(x for x in (re.sub(r"[ \t]+", " ", trim(line)) for line in clean.split("\n")) if x)


def notation(text):
    rules = [
        ("\r\n", "\n"), (r"\b([A-Za-z])\ufe00?\u20d7", r"\\vec{\1}"), (r"\b([A-Za-z])\s*→(?=\s*=)", r"\\vec{\1}"), (r"\b([A-Za-z])\s+→(?=\s)", r"\\vec{\1} "), (r"(?i)\belectric field\s+([A-Za-z])\s*→", r"electric field \\vec{\1}"),
        (r"([A-Za-zμελρσπ])0(?=[\s=^²³⁰⁻⁺₀₁₂₃₄₅₆₇₈₉]|\Z)", r"\1₀"), ("î", r"\\hat{i}"), ("ĵ", r"\\hat{j}"), ("k̂", r"\\hat{k}"), *[(rf"(?i)\b{x}\s*(?:hat|\^|\u0302)", rf"\\hat{{{x}}}") for x in "ijk"],
        (r"(?<!\\frac\{)([−-]?[0-9]?R)/\(μ[−-]1\)", r"\\frac{\1}{μ−1}"),
    ]
    for pattern, put in rules:
        text = re.sub(pattern, put, text, flags=re.A)
    return text


def marks(text):
    for p in (r"(?i)\[(\d+(?:\.\d+)?)\s*marks?\]", r"(?i)\((\d+(?:\.\d+)?)\s*marks?\)", r"(?im)(\d+)\s*marks?\s*$", r"\[(\d+(?:\.\d+)?)\]"):
        if m := re.search(p, text, re.A):
            return float(m[1])
    return None


def letters(text):
    return len(re.findall("[A-Za-z]", text))


def letter_share(text):
    solid = len(re.sub("[\\s\u00a0\ufeff]", "", text, flags=re.A))
    return letters(text) / solid if solid else 0.0


def is_notation(c):
    return not ("\x20" <= c <= "\x7e" or c in "\n\r\t§©¶" or "\u0900" <= c <= "\u097f")


def disallowed(text):
    return any("\u0900" <= c <= "\u097f" or c in "§©¶" for c in text)


def accepts_model(text):
    need = 0.30 if any(map(is_notation, text)) else 0.45
    return len(text) >= 10 and not disallowed(text) and letter_share(text) >= need and len(re.findall("[A-Za-z]{2,}", text)) >= 2


def readable(text):
    return 12 * len(re.findall("[A-Za-z]{3,}", text)) + 40 * letter_share(text) - 8 * sum(c in MISREAD for c in text)


def accepts_plain(text):
    math = any(map(is_notation, text))
    if len(text) < 12 or disallowed(text) or any(c in MISREAD for c in text) or letter_share(text) < (0.35 if math else 0.55):
        return False
    return math or (len(re.findall("[A-Za-z]{3,}", text)) >= 2 and readable(text) >= 18)


def text_questions(text):
    """[(place, number, text, marks)] of a plain text."""
    from examlake.functions.tables import cut_questions

    out = []
    for i, chunk in enumerate(cut_questions(text or "")):
        if len(chunk) < 15 or not (said := notation(english(chunk))):
            continue
        m = re.match(r"(?i)(?:\(?(\d{1,2})\)?[).:]\s*|Q(?:uestion)?\.?\s*(\d+)\s*[:.\-]?\s*)", chunk, re.A)
        out.append((i, int(m[1] or m[2]) if m else i + 1, said, marks(chunk)))
    return out[:300]


def page_lines(items):
    """[(body, mark at the margin)] of a page's items (x, y, text), 600 wide, from the top."""
    lines, top = [], None
    for x, y, s in sorted((i for i in items if i[2].strip()), key=lambda i: (-i[1], i[0], i[2])):
        if top is None or abs(y - top) > 4:
            lines.append([])
            top = y
        lines[-1].append((x, s))
    out = []
    for line in lines:
        line.sort()
        told = lambda keep: re.sub(r"\s+", " ", " ".join(s for x, s in line if x < 408 and keep(x)), flags=re.A).strip(" \t\n\r\f\v")  # noqa: B023, E731
        left, right, band = told(lambda x: x < 300), told(lambda x: x >= 300), told(lambda x: x >= 252)
        a, b, c = readable(right), readable(band), readable(left)
        body = right if a >= c and a >= b and a > 0 else band if b >= c and b > 0 else left if c > 0 else told(lambda x: True)
        margin = [s.strip(" ") for x, s in line if x >= 408 and re.fullmatch(r"\d{1,2}(\.\d+)?", s.strip(" "))]
        out.append((english(body), float(margin[-1]) if margin else None))
    return out


def layout_questions(pages):
    """[(number, text, marks)] before copies are dropped, of a paper's pages in order."""
    found = []
    for body, mark in (line for page in pages for line in page_lines(page)):
        if not body or re.match(r"SECTION\s*[-–—]|Page\s+\d+|P\.T\.O\.", body, re.I):
            continue
        m = re.match(r"(\d{1,2})\.(?!\d)\s*(.*)$", body, re.S | re.A)
        rest = m and m[2].strip(" \t\n\r\f\v")
        if m and (not rest or (not re.match(r"\d", rest) and (readable(rest) >= 8 or re.match(r"\(?[A-D]\)?[).:\s]", rest, re.I)))):
            found.append([int(m[1]), [rest], [mark]])
        elif found and (re.match(r"\(\s*[A-D]\s*\)|[A-D][).:\s]", body, re.I) or accepts_plain(body)):
            found[-1][1].append(body)
            found[-1][2].append(mark)
    out = []
    for i, (no, said, margins) in enumerate(found):
        body = "\n".join(x for x in said if x).strip(" \t\n\r\f\v")
        text = notation(body)
        if len(text) >= 15 and accepts_plain(text):
            out.append({"order": i + 1, "no": no, "text": text, "marks": next((m for m in margins if m and m > 0), None) or marks(body)})
    return out


def without_copies(rows):
    """The best row of each number, then those not like an earlier one that stays."""
    best = {}
    for r in sorted(rows, key=lambda r: r["order"]):
        score = len(r["text"]) + (50 if r["marks"] and r["marks"] > 0 else 0) + (10 if any(map(is_notation, r["text"])) else 0)
        if r["no"] not in best or score > best[r["no"]][0]:
            best[r["no"]] = (score, r)
    kept = []
    for _, r in sorted(best.values(), key=lambda x: (x[1]["no"], x[1]["order"])):
        flat = re.sub("[\\s\u00a0\ufeff]+", " ", r["text"].lower(), flags=re.A)
        mine = {w for w in re.sub("[^a-z0-9_ ]", "", flat).strip(" ").split(" ") if len(w) > 3}
        if not any(mine and w and len(mine & w) >= 0.72 * len(mine | w) for _, w in kept):
            kept.append((r, mine))
    return [r for r, _ in kept]
