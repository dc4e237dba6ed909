"""Plain Python versions of the operators of problems 1, 6 and 7, as the rules read."""

import re


def cells_of(line):
    """Cells of a record, or None where its quoting is broken."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j, buf = i + 1, []
            while True:
                if j >= n:
                    return None
                if line[j] == '"' and j + 1 < n and line[j + 1] == '"':
                    buf.append('"')
                    j += 2
                elif line[j] == "\\" and j + 1 < n and line[j + 1] == '"':
                    buf.append('"')
                    j += 2
                elif line[j] == '"':
                    break
                else:
                    buf.append(line[j])
                    j += 1
            i = j + 1
            if i < n and line[i] != ",":
                return None
            out.append("".join(buf))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1


LIST = re.compile(r"""\s*\[\s*(?:(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")(?:\s*,\s*(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"))*)?\s*\]\s*""", re.S)


def bad_count(v):
    return re.fullmatch("[0-9]*", (v or "").strip()) is None


def bad_list(v):
    return bool((v or "").strip()) and LIST.fullmatch(v) is None


def reasons(line, width=8, count=3, lists=5):
    cells = cells_of(line or "")
    if cells is None:
        return ["quoting"]
    if len(cells) != width:
        return ["column_count"]
    return ["times_cited"] * bad_count(cells[count]) + ["concepts"] * bad_list(cells[lists])


def split_plain(cell, qualifiers):
    """Values of a cell of names."""
    if re.fullmatch(r"\s*\[.*\]\s*", cell, re.S):
        import ast

        return [v.strip() for v in ast.literal_eval(cell.strip()) if v.strip()]
    spans = re.findall(r'"(?:[^"]|"")*"', cell)
    rest = re.sub(r'"(?:[^"]|"")*"', "", cell)
    if re.search(r"[;|/\n\r]", rest):
        sep = ";|/\n\r"
    elif not spans and rest.count(",") == 1 and all(p.strip() for p in rest.split(",")) and norm_half(rest.split(",")[1]) in qualifiers:
        sep = ""
    else:
        sep = ","
    out, buf, quoted = [], "", False
    for ch in cell:
        if ch == '"':
            quoted = not quoted
        if ch in sep and sep and not quoted:
            out.append(buf)
            buf = ""
        else:
            buf += ch
    out.append(buf)
    out = [v.strip(" \t\r\n\xa0﻿") for v in out]
    return [v[1:-1].strip() if len(v) > 1 and v[0] == v[-1] == '"' else v for v in out if v]


def norm_half(text):
    text = re.sub(r"\s*\([^()]*\)\s*$|\s+-\s.*$", "", text.lower())
    return re.sub(r"[\W_]+", " ", text).strip()


def split_codes(cell):
    return [v for v in re.split(r"[;|/,\s\xa0﻿\"'\[\]]+", cell) if v]
