"""Structure graphs of source code: imports, classes, functions and blocks of every file, nested by their lines.

One pass over a file's lines finds where every node ends. In Python a node ends before the next line that is not indented
deeper: open nodes are a stack of growing indents. In brace languages a node ends where the braces that were opened since
its first line are closed: nodes that have met a brace wait in a heap for the depth to fall back to theirs. A node's parent
is the narrowest other node over its lines. Files are rows; a file's nodes are made where its row is, without a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which files are code, their languages, and the lines that begin a node.
CODE_EXTENSIONS = (".py", ".pyw", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".c", ".h", ".cpp", ".hpp", ".cs")
LANGUAGES = {".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}
_PYTHON = (
    ("import", re.compile(r"^\s*(?:import\s+[\w\.]+|from\s+[\w\.]+\s+import\b)")),
    ("class", re.compile(r"^\s*class\s+([A-Za-z_][\w]*)")),
    ("function", re.compile(r"^\s*def\s+([A-Za-z_][\w]*)\s*\(")),
    ("block", re.compile(r"^\s*(if|elif|else|for|while|try|except|with)\b")),
)
_BRACES = (
    ("import", re.compile(r"^\s*import\b")),
    ("class", re.compile(r"^\s*(?:export\s+)?class\s+([A-Za-z_][\w]*)")),
    ("function", re.compile(r"^\s*(?:export\s+)?function\s+([A-Za-z_][\w]*)\s*\(")),
    ("block", re.compile(r"^\s*(if|for|while|switch|try|catch)\b")),
)
_OTHER = (
    ("class", re.compile(r"^\s*class\s+([A-Za-z_][\w]*)")),
    ("function", re.compile(r"^\s*(?:def|function)\s+([A-Za-z_][\w]*)")),
)

_TREE = "path string, position int, node_id string, parent_id string, node_type string, name string, level int, depth int, start_line int, end_line int, start_char int, end_char int"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """python, javascript, typescript, or generic for any other."""
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, extension(path)), F.lit("generic"))


def _starts(line: str, kinds: tuple) -> tuple[str, str] | None:
    for kind, pattern in kinds:
        if m := pattern.match(line):
            return kind, m[1] if pattern.groups else kind
    return None


def code_nodes(lines: list[str], spoken: str) -> list[list]:
    """[type, name, first line, last line] of every node in order, lines from 0."""
    return {"python": _indented, "javascript": _braced, "typescript": _braced}.get(spoken, _plain)(lines)


def _plain(lines: list[str]) -> list[list]:
    return [[*found, n, n] for n, line in enumerate(lines) if (found := _starts(line, _OTHER))]


def _indented(lines: list[str]) -> list[list]:
    nodes: list[list] = []
    above: list[tuple[int, list]] = []
    last = 0
    for n, line in enumerate(lines):
        if not line.strip():
            continue
        wide = line.replace("\t", "    ")
        indent = len(wide) - len(wide.lstrip(" "))
        while above and above[-1][0] >= indent:
            above.pop()[1][3] = last
        if found := _starts(line, _PYTHON):
            nodes.append([*found, n, n])
            if found[0] != "import":
                above.append((indent, nodes[-1]))
        last = n
    for _, node in above:
        node[3] = last
    return nodes


def _braced(lines: list[str]) -> list[list]:
    nodes: list[list] = []
    waiting: list[int] = []  # nodes that have met no brace yet
    within: list[tuple[int, int]] = []  # the others: minus the depth they began at, and their number
    began: list[int] = []
    depth = last = 0
    for n, line in enumerate(lines):
        if found := _starts(line, _BRACES):
            nodes.append([*found, n, n])
            began.append(depth)
            if found[0] != "import":
                waiting.append(len(nodes) - 1)
        if "{" in line:
            for k in waiting:
                heapq.heappush(within, (-began[k], k))
            waiting = []
        depth += line.count("{") - line.count("}")
        while within and -within[0][0] >= depth:
            nodes[heapq.heappop(within)[1]][3] = n
        if line.strip():
            last = n
    for k in [*waiting, *(k for _, k in within)]:
        nodes[k][3] = last
    return nodes


def parents(nodes: list[list]) -> list[int]:
    """For each node the narrowest other node that holds its lines, the first of equals; -1 for none."""
    first, last = (np.array([x[k] for x in nodes], np.int64) for k in (2, 3))
    out = []
    for n in range(len(nodes)):  # nodes begin on lines of their own, so only earlier ones can hold this one
        around = np.flatnonzero(last[:n] >= last[n])
        out.append(int(around[np.argmin((last - first)[around])]) if len(around) else -1)
    return out


def _file_rows(path: str, text: str, spoken: str, digest: str) -> list[tuple]:
    lines = text.split("\n")
    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).tolist()
    title = path.rsplit("/", 1)[-1]

    def row(at: int, kind: str, name: str, first: int, last: int, start: int, end: int) -> list:
        identity = hashlib.sha1("|".join([digest, kind, name, str(first), str(last), str(start), str(end), "0", ""]).encode()).hexdigest()
        line_hash = hashlib.sha256("\n".join(lines[first - 1 : last]).rstrip("\n").encode()).hexdigest()
        return [path, at, identity, None, kind, name, None, 0, first, last, start, end, spoken, line_hash]

    nodes = code_nodes(lines, spoken)
    root = row(-(1 << 30), "document", title, 1, len(lines), 0, len(text))
    rows = [row(n, kind, name, first + 1, last + 1, offsets[first], offsets[last] + len(lines[last])) for n, (kind, name, first, last) in enumerate(nodes)]
    for own, up in zip(rows, parents(nodes)):
        over = rows[up] if up >= 0 else root
        own[3], own[7] = over[2], over[7] + 1
    return [tuple(r) for r in [root, *rows]]


def code_graph(df: DataFrame, path_col: str = "source_path", text_col: str = "text") -> DataFrame:
    """The tree of every file as of ``structure.assemble`` (path, position, node_id, parent_id, node_type, name, level,
    depth, spans) with language and line_hash. Null texts are empty files: a document without nodes."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n")
    files = df.select(F.col(path_col).alias("path"), text.alias("text"), language(F.col(path_col)).alias("language"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in (_TREE + ", language string, line_hash string").split(", ")]
        for batch in batches:
            rows = [r for x in zip(batch["path"], batch["text"], batch["language"], batch["digest"]) for r in _file_rows(*x)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"level": "Int32"})

    return files.mapInPandas(cut, _TREE + ", language string, line_hash string")
