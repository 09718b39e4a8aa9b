"""A self-contained HTML report: a sample of cells in two dimensions, and tables.

Aggregation and sampling happen in Spark; what is rendered is bounded by the sample size
and by a few rows a group.  Data is embedded as JSON that can't end its script element;
no path and no external resource is in the page.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, functions as F

from popnet.operators.diagnostics import weight_quartiles
from popnet.operators.sampling import allocation, sample_size, stratified

_PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>Population-weighted networks</title>
<style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:right}svg{border:1px solid #ccc}</style>
<h1>Population-weighted networks</h1>%(summary)s<h2>Cells (circles) and centroids (squares) by %(axes)s1 and %(axes)s2</h2><svg id="plot" width="640" height="480"></svg><h2>Weights</h2>%(table)s
<script type="application/json" id="data">%(data)s</script>
<script>
const d = JSON.parse(document.getElementById("data").textContent), s = document.getElementById("plot");
const xs = [...d.cells, ...d.centroids].map(c => c[2]), ys = [...d.cells, ...d.centroids].map(c => c[3]);
const [x0, x1, y0, y1] = [xs, ys].flatMap(a => [a.reduce((p, q) => Math.min(p, q), Infinity), a.reduce((p, q) => Math.max(p, q), -Infinity)]);
const at = (v, a, b, n) => b > a ? 10 + (v - a) / (b - a) * (n - 20) : n / 2;
const names = [...new Set(d.cells.map(c => c[1]))];
const draw = (c, kind, size) => {
  const p = document.createElementNS("http://www.w3.org/2000/svg", kind), t = document.createElementNS("http://www.w3.org/2000/svg", "title");
  const x = at(c[2], x0, x1, 640), y = at(c[3], y0, y1, 480);
  for (const [k, v] of Object.entries(size(x, y))) p.setAttribute(k, v);
  p.setAttribute("fill", `hsl(${360 * names.indexOf(c[1]) / names.length} 60%% 50%%)`); t.textContent = `${c[0]} (${c[1]})`; p.append(t); s.append(p);
};
for (const c of d.cells) draw(c, "circle", (x, y) => ({cx: x, cy: y, r: 3}));
for (const c of d.centroids) draw(c, "rect", (x, y) => ({x: x - 5, y: y - 5, width: 10, height: 10, stroke: "black"}));
</script></html>
"""


#: Characters that could end a script element or a JavaScript line inside a string.
_ESCAPES = {ord(c): f"\\u{ord(c):04x}" for c in "<\u2028\u2029"}


def embedded(value: object) -> str:
    """JSON that is safe inside a script element."""
    return json.dumps(value, ensure_ascii=False, allow_nan=False).translate(_ESCAPES)


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    head = "".join(f"<th>{html.escape(str(k))}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{html.escape(f'{v:.6g}' if isinstance(v, float) else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def build(cells: DataFrame, centroids: DataFrame, axes: str, sizes: DataFrame, weights: DataFrame, summary: dict) -> str:
    """The page.  ``cells`` and ``centroids`` are (cell, grp, v) with one or two components; an action over bounded results.

    Quartiles are those of a target group's own cells and of all others: two rows a group.
    """
    groups = sizes.collect()
    budget = sample_size(sum(r["n"] for r in groups), len(groups))
    picked = stratified(cells, allocation(sizes, budget)).collect()
    points = lambda rows: [[str(r["cell"]), str(r["grp"]), r["v"][0], r["v"][1] if len(r["v"]) > 1 else 0.0] for r in rows]
    sides = weights.withColumn("cell_group", F.when(F.col("cell_group") == F.col("target_group"), "own").otherwise("others"))
    quartiles = [r.asDict() for r in weight_quartiles(sides).orderBy("target_group", "source_group").collect()]
    data = {"cells": points(picked), "centroids": points(centroids.orderBy("grp").collect())}  # a centroid a group
    return _PAGE % {"summary": _table([summary]), "table": _table(quartiles), "data": embedded(data), "axes": html.escape(axes)}
