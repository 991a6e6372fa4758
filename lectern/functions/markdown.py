"""Markdown blocks of a text table: code fences, pipe tables, lists and paragraphs.

Block boundaries depend on the lines before them, so one Python pass over a text finds them; Spark
partitions the texts and streams them through in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separator row, list items, compact truth-table cells.
SEPARATOR = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")
ITEM = re.compile(r"^\s*(?:[-*+]|(?P<number>\d+)[.)])\s+(?P<text>.+)$")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
BINARY = re.compile(r"0|1|true|false", re.IGNORECASE)

Found = tuple[dict, int] | None


def _cells(line: str) -> list[str]:
    return [cell.strip() for cell in line.strip().removeprefix("|").removesuffix("|").split("|")]


def _run(lines: list[str], start: int, wanted: Callable[[str], bool]) -> int:
    end = start
    while end < len(lines) and wanted(lines[end]):
        end += 1
    return end


def _fence(lines: list[str], i: int) -> Found:
    head = lines[i].strip()
    if not head.startswith("```"):
        return None
    end = _run(lines, i + 1, lambda x: not x.strip().startswith("```"))
    return {"type": "code", "language": head[3:].strip(), "text": "\n".join(lines[i + 1:end]).rstrip()}, end + 1


def _ruled_table(lines: list[str], i: int) -> Found:
    if "|" not in lines[i] or i + 1 >= len(lines) or not SEPARATOR.match(lines[i + 1]):
        return None
    width = len(_cells(lines[i]))
    end = _run(lines, i + 2, lambda x: "|" in x and len(_cells(x)) == width)
    return {"type": "table", "rows": [_cells(x) for x in (lines[i], *lines[i + 2:end])]}, end


def _bare_table(lines: list[str], i: int) -> Found:
    end = _run(lines, i, lambda x: "|" in x)
    rows = [_cells(x) for x in lines[i:end]]
    if len(rows) < 2 or {len(r) for r in rows} != {len(rows[0])}:
        return None
    flat = [x.replace("|", " ").split() for x in lines[i:end]]
    same_width = {len(r) for r in flat} == {len(flat[0])} and 2 <= len(flat[0]) <= 10
    if same_width and all(map(NAME.fullmatch, flat[0])) and all(BINARY.fullmatch(c) for r in flat[1:] for c in r):
        rows = flat
    return {"type": "table", "rows": rows}, end


def _listing(lines: list[str], i: int) -> Found:
    first = ITEM.match(lines[i])
    if first is None:
        return None
    ordered = first["number"] is not None

    def same(line: str) -> bool:
        match = ITEM.match(line)
        return match is not None and (match["number"] is not None) == ordered

    end = _run(lines, i, same)
    return {"type": "list", "ordered": ordered, "items": [ITEM.match(x)["text"].strip() for x in lines[i:end]]}, end


def text_blocks(text: str | None) -> list[dict]:
    """Blocks of one text in order; a text without any block is one paragraph."""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    found: list[dict] = []
    prose: list[str] = []

    def close() -> None:
        if prose:
            found.append({"type": "paragraph", "text": " ".join(prose)})
            prose.clear()

    i = 0
    while i < len(lines):
        hit = next((h for h in (reader(lines, i) for reader in (_fence, _ruled_table, _bare_table, _listing)) if h), None)
        if hit:
            close()
            block, i = hit
            found.append(block)
            continue
        if lines[i].strip():
            prose.append(lines[i].strip())
        else:
            close()
        i += 1
    close()
    return found or [{"type": "paragraph", "text": text or ""}]


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, position, type, text, language, ordered, items, rows)``, one row per block."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (k, n, b["type"], b.get("text"), b.get("language"), b.get("ordered"), b.get("items"), b.get("rows"))
                for k, value in zip(batch[key], batch[text], strict=True)
                for n, b in enumerate(text_blocks(value), 1)
            ]
            yield pd.DataFrame(out, columns=[key, "position", "type", "text", "language", "ordered", "items", "rows"])

    return df.select(key, text).mapInPandas(
        run,
        f"{key} {kind}, position int, type string, text string, language string, ordered boolean, "
        "items array<string>, rows array<array<string>>",
    )


def rendered(block: Column | None = None) -> Column:
    """Canonical Markdown of a block row."""
    c = (lambda n: block[n]) if block is not None else F.col
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = lambda cells: row(F.transform(cells, lambda _: F.lit("---")))
    head = F.get(c("rows"), F.lit(0))
    body = F.transform(F.slice(c("rows"), 2, F.greatest(F.size(c("rows")) - 1, F.lit(0))), row)
    table = F.array_join(F.concat(F.array(row(head), rule(head)), body), "\n")
    mark = lambda i: F.when(c("ordered"), F.concat((i + 1).cast("string"), F.lit("."))).otherwise("-")
    items = F.array_join(F.transform(c("items"), lambda x, i: F.concat(mark(i), F.lit(" "), x)), "\n")
    code = F.concat(F.lit("```"), F.coalesce(c("language"), F.lit("")), F.lit("\n"), c("text"), F.lit("\n```"))
    return F.when(c("type") == "table", table).when(c("type") == "list", items).when(c("type") == "code", code).otherwise(c("text"))


def markdown(block_rows: DataFrame, key: str) -> DataFrame:
    """The canonical Markdown of every text, from its block rows."""
    each = block_rows.select(key, F.struct("position", rendered().alias("md")).alias("b"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["md"]), "\n\n").alias("markdown"))
