"""Reports of a run as text and HTML, made from a few aggregate rows."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from .operators.stats import FIELDS

#: From which share of matches a query type, and from which match rate a run, is called what.
BADGES = ((40, "Primary"), (20, "Secondary"), (0, "Minor"))
BANDS = ((60, "high"), (40, "moderate"), (20, "low"), (0, "very low"))


def _called(x: float, steps: tuple[tuple[float, str], ...]) -> str:
    return next(name for least, name in steps if x >= least)


def facts(coverage: DataFrame, rates: DataFrame, distribution: DataFrame, contribution: DataFrame | None = None, passes: DataFrame | None = None) -> dict:
    """The run's figures; a row of totals, a row a query type, a row of contributions and of passes."""
    c = coverage.where("source_file is null").first()
    r = rates.where("source_file is null").first()
    kinds = [(x.query_type, x.n, 100 * x.share) for x in distribution.orderBy("n", ascending=False).collect()]  # a row a strategy
    first = lambda d: d.first().asDict() if d is not None else {}
    return {"references": r.n_references, "matches": r.n_matches, "rate": r.match_rate, "fields": {f: c[f"n_{f}"] for f in FIELDS}, "kinds": kinds, "contribution": first(contribution), "passes": first(passes)}


def text(coverage: DataFrame, rates: DataFrame, distribution: DataFrame, contribution: DataFrame | None = None, passes: DataFrame | None = None) -> str:
    """Totals, coverage of fields, what each field contributed, matches by query type and by pass."""
    x = facts(coverage, rates, distribution, contribution, passes)
    part = lambda n, of: f"{n} ({100 * n / max(1, of):.1f}%)"
    lines = [f"Total references: {x['references']}", f"Total matches: {x['matches']}", f"Match rate: {x['rate']:.1f}%"]
    lines += [f"With {f}: {part(n, x['references'])}" for f, n in x["fields"].items()]
    lines += [f"Matched {k[3:].replace('_', ' ')}: {part(n, x['matches'])}" for k, n in x["contribution"].items() if k.startswith("by_")]
    lines += [f"{kind}: {n} ({share:.1f}%)" for kind, n, share in x["kinds"]]
    lines += [f"{k[2:].replace('_', ' ').capitalize()}: {n}" for k, n in x["passes"].items()]
    return "\n".join(lines) + "\n"


_STYLE = "body{font:15px sans-serif;max-width:60em;margin:2em auto}.box{display:inline-block;border:1px solid #bbb;border-radius:6px;padding:.6em 1.2em;margin:0 .6em .6em 0}.box b{display:block;font-size:1.6em}table{border-collapse:collapse}td,th{border-bottom:1px solid #ddd;padding:.25em .8em;text-align:left}.badge{border-radius:4px;padding:.1em .5em;background:#eee}.bar{background:#4a7;height:.7em}"


def page(title: str, x: dict) -> str:
    """The figures of ``facts`` as a page: boxes of totals, a table of fields, one of query types with their badges."""
    boxes = [("references", x["references"]), ("matches", x["matches"]), (f"match rate, {_called(x['rate'], BANDS)}", f"{x['rate']:.1f}%")]
    boxes += [(k[2:].replace("_", " "), n) for k, n in x["passes"].items() if k not in ("n_references",)]
    box = "".join(f"<div class='box'><b>{escape(str(v))}</b>{escape(k)}</div>" for k, v in boxes)
    share = lambda n, of: 100 * n / max(1, of)
    got = lambda f: x["contribution"].get(f"by_{f}", x["contribution"].get("by_title_exact", 0) + x["contribution"].get("by_title_fuzzy", 0) if f == "title" else 0)
    fields = "".join(f"<tr><td>{escape(f)}</td><td>{n}</td><td>{share(n, x['references']):.1f}%</td><td>{got(f)}</td><td>{share(got(f), x['matches']):.1f}%</td><td><div class='bar' style='width:{share(got(f), x['matches']):.0f}px'></div></td></tr>" for f, n in x["fields"].items())
    kinds = "".join(f"<tr><td>{escape(k)}</td><td>{n}</td><td>{s:.1f}%</td><td><span class='badge'>{_called(s, BADGES)}</span></td></tr>" for k, n, s in x["kinds"])
    return (
        f"<!doctype html><html lang='en'><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style><h1>{escape(title)}</h1>{box}"
        f"<h2>Fields</h2><table><tr><th>field</th><th>given</th><th>of references</th><th>matched</th><th>of matches</th><th></th></tr>{fields}</table>"
        f"<h2>Query types</h2><table><tr><th>type</th><th>matches</th><th>share</th><th></th></tr>{kinds}</table></html>"
    )


def html(title: str, body: str) -> str:
    """A text report as a plain table."""
    rows = "".join(f"<tr><td>{escape(k)}</td><td>{escape(v)}</td></tr>" for k, _, v in (line.partition(": ") for line in body.splitlines()))
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1><table>{rows}</table>"
