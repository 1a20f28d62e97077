"""The audit of a translated package: was the text applied, were the auxiliary parts, is the result clean, was it packed again.

Evidence is rows of path, kind, name, value, ts; of each (kind, name) the latest counts, so that evidence may come again and in any order.
Kinds: ``source_part`` and ``final_part`` (name; a final part's value is its size), ``quality`` (number of findings), ``package`` (size of the
result; negative: it can't be opened), ``package_part`` (name). ``audit`` is the batch form; ``follow`` the stateful stream with the same verdicts.

Steps: ``apply``, ``auxiliary``, ``quality``, ``package``. A package without any source part has an ``auxiliary`` step that doesn't apply,
one without package evidence a ``package`` step that doesn't. Null paths or kinds take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAIN = "word/document.xml"
#: Other places at which the written text is looked for, and the least sizes that count as a text and as a package.
ELSEWHERE, LEAST_TEXT, LEAST_PACKAGE = ("output.xml", "translated.xml"), 200, 1024
#: Auxiliary parts by the beginning of their names, and what they are called.
AUXILIARY = {"word/numbering.xml": "numbering", "word/header": "headers/footers", "word/footer": "headers/footers", "word/comments.xml": "comments", "word/footnotes.xml": "footnotes", "word/endnotes.xml": "endnotes"}
EVIDENCE = "path string, kind string, name string, value long, ts timestamp"
FOUND = "path string, step string, severity string, summary string"
RANK = {"PASS": 0, "N/A": 0, "WARN": 1, "FAIL": 2}
Evidence = dict[tuple[str, str], int]


def _auxiliary(names: list[str]) -> dict[str, str]:
    of = lambda n: next((kind for start, kind in AUXILIARY.items() if n.startswith(start) and n.endswith(".xml")), None)
    return {n: of(n) for n in sorted(names) if of(n)}


def judge(evidence: Evidence) -> list[tuple[str, str, str]]:
    """(step, severity, summary) of one package's evidence, {(kind, name): value}."""
    names = lambda kind: [n for k, n in evidence if k == kind]
    final, out = {n: v for (k, n), v in evidence.items() if k == "final_part"}, []
    if MAIN in final:
        size = final[MAIN]
        out.append(("apply", "FAIL", f"text of {size} bytes") if size < LEAST_TEXT else ("apply", "PASS", f"{size} bytes"))
    else:
        other = next((n for n in ELSEWHERE if n in final), None)
        out.append(("apply", "WARN", f"text at {other}") if other else ("apply", "FAIL", "no text was written"))
    source, wanted = names("source_part"), _auxiliary(names("source_part"))
    missing = [n for n in wanted if n not in final]
    if not source:
        out.append(("auxiliary", "N/A", "no source is known"))
    elif not final:
        out.append(("auxiliary", "FAIL", "nothing was written"))
    elif not wanted:
        out.append(("auxiliary", "N/A", "the source has no auxiliary parts"))
    else:
        kinds = ", ".join(sorted({wanted[n] for n in (missing or wanted)}))
        out.append(("auxiliary", "FAIL", f"{len(missing)} missing: {kinds}") if missing else ("auxiliary", "PASS", f"{len(wanted)} present: {kinds}"))
    found = evidence.get(("quality", ""))
    if MAIN not in final:
        out.append(("quality", "FAIL", "there is no text to look at"))
    elif found is None:
        out.append(("quality", "WARN", "it was not looked at"))
    else:
        out.append(("quality", "FAIL", f"{found} findings") if found else ("quality", "PASS", "no findings"))
    size = evidence.get(("package", ""))
    if size is None:
        out.append(("package", "N/A", "no result is known"))
    elif 0 <= size < LEAST_PACKAGE:
        out.append(("package", "FAIL", f"result of {size} bytes"))
    elif size < 0:
        out.append(("package", "FAIL", "the result is no archive"))
    elif MAIN not in names("package_part"):
        out.append(("package", "FAIL", "the result has no text"))
    else:
        out.append(("package", "PASS", f"{size} bytes, {len(names('package_part'))} parts"))
    return out


def of_parts(parts: DataFrame, kind: str, ts) -> DataFrame:
    """Evidence from parts (path, part, content)."""
    return parts.where("part is not null").select("path", F.lit(kind).alias("kind"), F.col("part").alias("name"), F.octet_length("content").cast("long").alias("value"), ts.alias("ts"))


def of_packages(packages: DataFrame, parts: DataFrame, ts) -> DataFrame:
    """Evidence from packages (path, content) and what ``sources.packages.parts`` made of them."""
    broken = parts.where("error is not null").select("path").distinct().withColumn("broken", F.lit(True))
    size = F.when(F.coalesce("broken", F.lit(False)) & (F.octet_length("content") >= LEAST_PACKAGE), -1).otherwise(F.octet_length("content")).cast("long")
    whole = packages.join(broken, "path", "left").select("path", F.lit("package").alias("kind"), F.lit("").alias("name"), size.alias("value"), ts.alias("ts"))
    return whole.unionByName(of_parts(parts, "package_part", ts))


def audit(evidence: DataFrame) -> DataFrame:
    """FOUND rows for each package."""
    known = evidence.where("path is not null and kind is not null").groupBy("path", "kind", F.coalesce("name", F.lit("")).alias("name")).agg(F.max(F.struct("ts", "value")).alias("last"))
    gathered = known.groupBy("path").agg(F.collect_list(F.struct("kind", "name", F.col("last.value").alias("value"))).alias("evidence"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *found) for path, e in zip(batch["path"], batch["evidence"]) for found in judge({(x["kind"], x["name"]): x["value"] or 0 for x in e})]
            yield pd.DataFrame(rows, columns=["path", "step", "severity", "summary"])

    return gathered.mapInPandas(run, FOUND)


def overall(found: DataFrame, strict: bool = False) -> DataFrame:
    """path, verdict: the worst severity of each package's steps; strict makes warnings failures."""
    rank = F.max(sum((F.when(F.col("severity") == s, r).otherwise(0) for s, r in RANK.items()), F.lit(0)))
    verdict = F.when(F.col("r") == 2, "FAIL").when(F.col("r") == 1, "FAIL" if strict else "WARN").otherwise("PASS")
    return found.groupBy("path").agg(rank.alias("r")).select("path", verdict.alias("verdict"))


def follow(evidence: DataFrame, late: str = "1 hour", keep: str = "7 days") -> DataFrame:
    """The audit over a stream of evidence: whenever evidence of a package comes, its FOUND rows anew, with ``open`` true.

    The state of a package holds the latest of each (kind, name). When no evidence of it came for ``keep`` of event time, it ends with its
    rows once more, ``open`` false, and is forgotten."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds, names, values, times = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        held = {(k, n): (t, v) for k, n, v, t in zip(kinds, names, values, times)}
        expired = state.hasTimedOut
        if expired:
            state.remove()
        else:
            for batch in batches:
                for kind, name, value, ts in zip(batch["kind"], batch["name"], batch["value"], batch["ts"]):
                    one = (int(pd.Timestamp(ts).value // 1000), 0 if pd.isna(value) else int(value))
                    at = (kind, name if isinstance(name, str) else "")
                    held[at] = max(held.get(at, one), one)
            order = sorted(held)
            state.update(([k for k, _ in order], [n for _, n in order], [held[x][1] for x in order], [held[x][0] for x in order]))
            newest = max(t for t, _ in held.values()) // 1000
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)
        rows = [(*key, *found, not expired) for found in judge({at: v for at, (_, v) in held.items()})]
        yield pd.DataFrame(rows, columns=["path", "step", "severity", "summary", "open"])

    usable = evidence.where("path is not null and kind is not null").withWatermark("ts", late)
    return usable.groupBy("path").applyInPandasWithState(update, FOUND + ", open boolean", "kinds array<string>, names array<string>, amounts array<long>, times array<long>", "update", GroupStateTimeout.EventTimeTimeout)
