"""Plain walks over one text: what the windows over lines and pieces are held against."""

import re

from snipdex.operators.extract import CSHARP_LABELS, CSHARP_MODIFIERS, _brace_pairs, _Lines, _stem, _whole
from snipdex.operators.masking import PYTHON_NOISE, _csharp_mask, _masked

def python_blocks(path: str, text: str):
    """Classes and functions by indentation; a block ends at the latest before the next header.

    Strings and comments are blanked out first, and a line within open brackets or behind a backslash belongs to the
    line before, so signatures may run over lines and texts at the left margin end nothing.
    """
    lines, masked = text.split("\n"), _masked(text, PYTHON_NOISE).split("\n")
    logical: list[tuple[int, int]] = []  # first line and indent of each statement
    headers: list[tuple[int, str, str]] = []
    depth, joined = 0, False
    for n, line in enumerate(masked):
        if line.strip() and not depth and not joined:
            indent = len(line) - len(line.lstrip())
            logical.append((n, indent))
            names = line.split(None, 2)
            if names[0] == "async":
                names = line.split(None, 3)[1:]
            if len(names) > 1 and names[0] in ("class", "def") and (name := re.match(r"\w+", names[1])):
                headers.append((len(logical) - 1, names[0], name[0]))
        depth = max(0, depth + sum(c in "([{" for c in line) - sum(c in ")]}" for c in line))
        joined = line.rstrip().endswith("\\")
    if not headers:
        yield _whole(path, text)
    stops = [h[0] for h in headers[1:]] + [len(logical)]
    for (at, word, name), stop in zip(headers, stops):
        start, indent = logical[at]
        inner = next((i for i in range(at + 1, stop) if logical[i][1] <= indent), stop)
        end = logical[inner][0] if inner < len(logical) else len(lines)
        label = "Class" if word == "class" else "Function"
        owner = name if word == "class" else _stem(path)
        yield "", owner, f"{name} ({label})", label.lower(), "\n".join(lines[start:end]), start + 1, end


CSHARP_TYPE = re.compile(r"\b(class|interface|struct|record|enum)\s+(?:(?:class|struct)\s+)?(\w+)")
CSHARP_NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)\s*$")


def _declarations(masked: str, start: int, end: int, pairs: dict[int, int]):
    """Declarations between two offsets: first and last offset, and the brace of the body if any."""
    at = begin = start
    stops = re.compile(r"[{};]")
    while match := stops.search(masked, at, end):
        at, body = match.end(), None
        if match[0] == "}":
            begin = at
            continue
        last = match.start()
        if match[0] == "{":
            body = match.start()
            last = pairs.get(body)
            if last is None:
                return
            at = last + 1
            # A field or property initializer runs on after the brace.
            tail = re.compile(r"\s*(=[^;{}]*|[,.)][^;{}]*)?;").match(masked, at, end)
            head = masked[begin:body]
            if tail and ("=" in head or tail[1]):
                last, at = tail.end() - 1, tail.end()
        first = begin + len(masked[begin:last]) - len(masked[begin:last].lstrip())
        if masked[first : last + 1].strip(" \t\r\n;"):
            yield first, last, body
        begin = at


CSHARP_CALL = re.compile(r"(\w+)\s*(?:<[^<>()]*(?:<[^<>()]*>[^<>()]*)*>)?\s*\(")
def _csharp_member(head: str, owner: str, has_body: bool):
    """(kind, name) of a member declaration from the text before its body."""
    head = re.sub(r"^(\s*\[[^\]]*\])+", "", head).strip()
    value = re.search(r"=>|=(?!=)", head)
    front = head[: value.start()] if value else head
    if re.search(r"\b(delegate|operator)\b|~\w+\s*\(|\bthis\s*\[", front) or CSHARP_TYPE.search(front):
        return
    last_word = re.search(r"(\w+)\s*$", front)
    call = next((c[1] for c in CSHARP_CALL.finditer(front) if c[1] not in CSHARP_MODIFIERS), None)
    if re.search(r"\bevent\b", front):
        if has_body and last_word:
            yield "event", last_word[1]
    elif call:
        yield ("constructor" if call == owner else "method"), call
    elif value and value[0] == "=" or not has_body and not value:
        flat = re.sub(r"<[^;=]*>|\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ", head)
        for part in flat.split(","):
            name = re.search(r"(\w+)\s*$", part.split("=")[0])
            if name:
                yield "field", name[1]
    elif last_word:
        yield "property", last_word[1]


def csharp_members(path: str, text: str):
    """Types that are not nested, and their direct members, with their whole code."""
    masked = _csharp_mask(text)
    pairs, line = _brace_pairs(masked), _Lines(text)

    def row(namespace, owner, kind, name, first, last):
        code = text[first : last + 1]
        start_line = line(first)
        last_line = start_line + text.count("\n", first, last)
        return namespace, owner, f"{name} ({CSHARP_LABELS[kind]})", kind, code, start_line, last_line

    def scope(namespace: str, start: int, end: int):
        for first, last, body in _declarations(masked, start, end, pairs):
            head = masked[first : body if body is not None else last]
            space = CSHARP_NAMESPACE.search(head)
            if space:
                inner = f"{namespace}.{space[1]}" if namespace and body is not None else space[1]
                if body is None:
                    namespace = inner
                else:
                    yield from scope(inner, body + 1, pairs[body])
                continue
            kind = CSHARP_TYPE.search(re.sub(r"^(\s*\[[^\]]*\])+", "", head))
            if not kind:
                continue
            yield row(namespace, kind[2], kind[1], kind[2], first, last)
            if body is None or kind[1] == "enum":
                continue
            for m_first, m_last, m_body in _declarations(masked, body + 1, pairs[body], pairs):
                m_head = masked[m_first : m_body if m_body is not None else m_last]
                for m_kind, m_name in _csharp_member(m_head, kind[2], m_body is not None):
                    yield row(namespace, kind[2], m_kind, m_name, m_first, m_last)

    yield from scope("", 0, len(masked))
