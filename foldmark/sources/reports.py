"""Reports from small result tables: Markdown, HTML and script files."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.functions.scalars import script_name, shell_quote

def _widths(df: DataFrame) -> list[int]:
    """Characters of the widest cell of each column as Python writes it, found row by row."""
    widths = [len(c) for c in df.columns]
    for row in df.toLocalIterator():
        widths = [max(w, len(_cell(v))) for w, v in zip(widths, row)]
    return widths


def _cell(v: Any) -> str:
    return "" if v is None else str(v).replace("|", "\\|").replace("\r", "").replace("\n", "<br>")


def markdown_lines(title: str, sections: Mapping[str, DataFrame], made_at: str) -> Iterator[str]:
    """Lines of a report with all rows of every section. Rows pass one by one, twice: for the widths of the columns, then for the table."""
    yield from (f"# {title}", "", f"Generated {made_at}")
    for name, df in sections.items():
        yield from ("", f"## {name}", "")
        widths = [max(3, w) for w in _widths(df)]
        line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths)) + " |"  # noqa: B023, E731
        empty = True
        for row in df.toLocalIterator():
            if empty:
                yield line(df.columns)
                yield "| " + " | ".join("-" * w for w in widths) + " |"
                empty = False
            yield line([_cell(v) for v in row])
        if empty:
            yield "Nothing found."


def html_pieces(title: str, sections: Mapping[str, DataFrame], made_at: str) -> Iterator[str]:
    """Pieces of one page with a sortable, filterable table per section, whose rows, all of them, are embedded as JSON and pass one by one."""
    # inside a script element only "</" could end it, and two separators are line ends to older parsers
    safe = lambda v: json.dumps(v, default=str).replace("</", "<\\/").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    before, after = _PAGE.replace("@TITLE@", html.escape(title)).replace("@MADE@", html.escape(made_at)).split("@DATA@")
    yield before + "{"
    for k, (name, df) in enumerate(sections.items()):
        yield f"{', ' if k else ''}{safe(name)}: {{\"columns\": {safe(df.columns)}, \"rows\": ["
        for n, row in enumerate(df.toLocalIterator()):
            yield (", " if n else "") + safe(list(row))
        yield "]}"
    yield "}" + after


def markdown_report(title: str, sections: Mapping[str, DataFrame], made_at: str) -> str:
    """The whole report as a text, for reports that fit the driver; write_report streams larger ones."""
    return "\n".join(markdown_lines(title, sections, made_at)) + "\n"


def html_report(title: str, sections: Mapping[str, DataFrame], made_at: str) -> str:
    """The whole page as a text, for reports that fit the driver."""
    return "".join(html_pieces(title, sections, made_at))


def write_report(path: str, title: str, sections: Mapping[str, DataFrame], made_at: str) -> None:
    """Write a report to a file, as a page if its name ends in .html, else as Markdown. No more than a batch of rows is held at a time."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(html_pieces(title, sections, made_at) if path.endswith(".html") else (line + "\n" for line in markdown_lines(title, sections, made_at)))


_PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>@TITLE@</title>
<style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 8px}th{cursor:pointer;background:#eee}</style></head>
<body><h1>@TITLE@</h1><p>Generated @MADE@</p><div id="report"></div>
<script id="data" type="application/json">@DATA@</script>
<script>
const report = document.getElementById("report"), PAGE = 25;
for (const [name, part] of Object.entries(JSON.parse(document.getElementById("data").textContent))) {
  const head = document.createElement("h2"), find = document.createElement("input"), table = document.createElement("table"), more = document.createElement("button");
  head.textContent = name; find.placeholder = "filter"; more.textContent = "next page";
  report.append(head, find, table, more);
  let order = -1, down = false, page = 0;
  const show = () => {
    let rows = part.rows.filter(r => r.some(v => String(v ?? "").toLowerCase().includes(find.value.toLowerCase())));
    if (order >= 0) rows = rows.slice().sort((a, b) => (a[order] > b[order] ? 1 : a[order] < b[order] ? -1 : 0) * (down ? -1 : 1));
    if (page * PAGE >= rows.length) page = 0;
    table.replaceChildren();
    const top = table.insertRow();
    part.columns.forEach((c, k) => { const th = document.createElement("th"); th.textContent = c; th.onclick = () => { down = order === k && !down; order = k; show(); }; top.append(th); });
    for (const r of rows.slice(page * PAGE, (page + 1) * PAGE)) { const tr = table.insertRow(); for (const v of r) tr.insertCell().textContent = v ?? ""; }
  };
  find.oninput = show; more.onclick = () => { page++; show(); }; show();
}
</script></body></html>
"""


def copy_script_rows(pairs: DataFrame) -> DataFrame:
    """file_name and body of one shell script per row of pairs (position, priority, action, folder, remote_url, branch, reason). Every value is quoted for the shell; rows without a remote are left out."""
    q = lambda c: shell_quote(F.col(c))
    lines = (
        F.lit("#!/bin/bash\nset -euo pipefail\n# "), F.regexp_replace("reason", r"[\r\n]+", " "), F.lit("\nfolder="), q("folder"), F.lit("\nremote="), q("remote_url"), F.lit("\nbranch="), q("branch"),
        F.lit('\ncd -- "$folder"\n[ -d .git ] || git init\ngit remote remove staging 2>/dev/null || true\ngit remote add staging "$remote"\ngit checkout -B "$branch"\ngit add -A\ngit commit -m "import of $folder" || true\ngit push staging "$branch"\n'),
    )
    name = script_name(F.col("position"), F.col("priority"), F.col("action"), F.substring_index("folder", "/", -1))
    return pairs.where("remote_url is not null and remote_url <> ''").select(name.alias("file_name"), F.concat(*lines).alias("body"))


def write_scripts(rows: DataFrame, folder: str) -> int:
    """Write one file per row (file_name, body) below a folder; the rows are streamed, not collected."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in rows.toLocalIterator():
        with open(os.path.join(folder, os.path.basename(row["file_name"])), "w") as f:
            f.write(row["body"])
        n += 1
    return n
