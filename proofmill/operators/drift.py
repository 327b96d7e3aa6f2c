"""Schemas that drift between files: one consistent table, and a report of every change.

Each field of each file is profiled by a sketch of its values (hashed word counts of bounded width), the kinds of its
values and its header.  Sketches are summed over all files per header, which gives a header a meaning even in a file
that holds little of it.  Headers are tied to target columns by sketch and name; between a file and the one before it
of the same template the fields left over are paired by a maximum-weight bipartite matching, and pairs above a threshold
are renames.

Sizes: a sketch has at most SKETCH entries, a file at most its number of headers; rows are only ever pre-aggregated
per (file, header), once, and all else is derived from that table.  Template order is found in two steps (within a day,
then between days) so that no single task sorts all the files of a dominant template.

Defined results: a payload that is null, malformed or no object has no fields; headers that differ only in letter case,
blanks or punctuation are one field; a field present only with nulls is present but has no kind, hence no retyping;
equal counts of two kinds keep the kind of the file before where it is among them; repeated rows count as rows; rows of
files that are not listed are ignored; a file without any field counts as an empty file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from proofmill.runtime import cut_lineage, spread

SKETCH = 256
TARGETS = ["requirement", "specification", "remark", "symbol_exact_wording", "language", "verification", "package_panel", "remark_link"]
#: Least score of a header for a target column, and of two headers for a rename.
LEAST_TARGET, LEAST_RENAME = 0.45, 0.45


def name_key(header: Column) -> Column:
    return F.regexp_replace(F.lower(header), r"[^\p{L}\p{N}]", "")


def _words(text: str | Column) -> Column:
    """Letters-only words of a value; names inside objects, numbers and truth values say nothing about the meaning."""
    plain = F.regexp_replace(F.lower(text), r'"[\w ]+"\s*:|\btrue\b|\bfalse\b', " ")
    return F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: F.length(w) > 0)


def cells(raw: DataFrame) -> DataFrame:
    """raw_id, file_id, header, name, kind, value: one row per cell of a payload that is an object."""
    fields = raw.select("raw_id", "file_id", F.explode(F.from_json("payload", "map<string,variant>")).alias("header", "v"))
    made_of = F.schema_of_variant("v")
    kind = (
        F.when(F.col("v").isNull() | F.is_variant_null("v"), None)
        .when(made_of.startswith("STRING"), "text").when(made_of.startswith("BOOLEAN"), "boolean")
        .when(made_of.startswith("ARRAY"), "list").when(made_of.startswith("OBJECT"), "object").otherwise("number")
    )
    return fields.select("raw_id", "file_id", "header", name_key(F.col("header")).alias("name"), kind.alias("kind"), F.try_variant_get("v", "$", "string").alias("value"))


def _buckets(text: str | Column) -> Column:
    return F.transform(_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(SKETCH)).cast("int"))


def profiles(cells_: DataFrame) -> DataFrame:
    """file_id, name, b, kind, n, header: counts of each header's kinds (b null) and of its word buckets (kind null)."""
    none = F.array(F.lit(None).cast("int"))
    each = cells_.select("file_id", "name", "kind", "header", F.explode(F.concat(none, F.coalesce(_buckets("value"), F.array().cast("array<int>")))).alias("b"))
    by = ["file_id", "name", "b", F.when(F.col("b").isNull(), F.col("kind")).alias("kind")]
    return cut_lineage(each.groupBy(*by).agg(F.count("*").alias("n"), F.min("header").alias("header")))


def header_targets(profiles_: DataFrame, checklist: DataFrame) -> DataFrame:
    """name, target (null for a field the target table lacks): each header's column by sketch and name."""
    names = profiles_.select("name").distinct()
    want = F.array([F.struct(F.lit(t).alias("target"), F.lit(t.replace("_", "")).alias("target_name")) for t in TARGETS])
    pairs = names.select("name", F.explode(want).alias("t")).select("name", "t.*")
    wide = checklist.select(F.explode(F.array([F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias("value")) for t in TARGETS])).alias("c")).select("c.*")
    per_name = profiles_.where("b is not null").groupBy("name", "b").agg(F.sum("n").cast("double").alias("n"))
    own = per_name.join(F.broadcast(pairs.where("name = target_name").select("name", "target")), "name")  # at most as many rows as targets
    model = own.select("target", "b", "n").unionByName(wide.select("target", F.explode(_buckets("value")).alias("b")).groupBy("target", "b").agg(F.count("*").cast("double").alias("n")))
    model = model.withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy("target"))).groupBy("target", "b").agg(F.sum("n").alias("m"))
    norm = per_name.groupBy("name").agg(F.sqrt(F.sum(F.col("n") ** 2)).alias("norm"))
    model_norm = model.groupBy("target").agg(F.sqrt(F.sum(F.col("m") ** 2)).alias("model_norm"))
    dots = per_name.join(F.broadcast(model), "b").groupBy("name", "target").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))  # targets x SKETCH rows
    like = dots.join(norm, "name").join(F.broadcast(model_norm), "target").select("name", "target", (F.col("dot") / (F.col("norm") * F.col("model_norm"))).alias("like"))
    close = 1 - F.levenshtein("name", "target_name") / F.greatest(F.length("name"), F.length("target_name"))
    part = F.col("target_name").contains(F.col("name")) | F.col("name").contains(F.col("target_name"))
    alike = F.greatest(close, F.when(part & (F.length("name") > 2), 0.7).otherwise(0.0))
    scored = pairs.join(like, ["name", "target"], "left").withColumn("score", 0.75 * F.coalesce("like", F.lit(0.0)) + 0.25 * alike + F.when(F.col("name") == F.col("target_name"), 1.0).otherwise(0.0))
    best = scored.groupBy("name").agg(F.max_by(F.struct("target", "score"), F.struct("score", "target")).alias("s"))
    return best.select("name", F.when(F.col("s.score") >= LEAST_TARGET, F.col("s.target")).alias("target"))


def _before(files: DataFrame) -> DataFrame:
    """file_id, prev_id: the file before it of its template (null for the first)."""
    f = files.select("file_id", "template_id", "exported_at", F.to_date("exported_at").alias("day"))
    inside = f.withColumn("prev_id", F.lag("file_id").over(Window.partitionBy("template_id", "day").orderBy("exported_at", "file_id")))
    ends = f.groupBy("template_id", "day").agg(F.max_by("file_id", F.struct("exported_at", "file_id")).alias("last_id"))
    ends = ends.withColumn("before", F.lag("last_id").over(Window.partitionBy("template_id").orderBy("day"))).drop("last_id")
    return inside.join(ends, ["template_id", "day"]).select("file_id", F.coalesce("prev_id", "before").alias("prev_id"))


_FIELD = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("header", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("kinds", T.MapType(T.StringType(), T.LongType())), T.StructField("sketch", T.MapType(T.IntegerType(), T.LongType())),
]))


def assign(score: list[list[float]]) -> list[int]:
    """Maximum-weight bipartite matching (shortest augmenting paths): the column of each row, -1 for none."""
    if not score or not score[0]:
        return [-1] * len(score)
    rows, cols = len(score), len(score[0])
    size = max(rows, cols)
    cost = [[-(score[i][j] if i < rows and j < cols else 0.0) for j in range(size)] for i in range(size)]
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (size + 1), [False] * (size + 1), [0] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, size + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * rows
    for j in range(1, cols + 1):
        if match[j] <= rows:
            out[match[j] - 1] = j - 1
    return out


def _cosine(a: dict, b: dict) -> float:
    dot = sum(n * b.get(k, 0) for k, n in a.items())
    return dot / ((sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5) if dot else 0.0


def _alike(a: str, b: str) -> float:
    """Share of letter pairs in common."""
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} or {s} for s in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def rename_score(a: dict, b: dict) -> float:
    """How well two fields of consecutive files pass for one: target column, values, name and kind."""
    if a["target"] and b["target"]:
        if a["target"] != b["target"]:
            return 0.0
        same = 0.5
    else:
        same = 0.0 if not (a["target"] or b["target"]) else -0.3
    x, y = dict(a["sketch"] or []), dict(b["sketch"] or [])
    kinds = bool({k for k, _ in a["kinds"] or []} & {k for k, _ in b["kinds"] or []})
    return same + 0.5 * _cosine(x, y) + 0.3 * _alike(a["name"], b["name"]) + 0.05 * kinds


def _main_kind(field: dict, keep: str | None = None) -> str | None:
    kinds = dict(field["kinds"] or [])
    if not kinds:
        return None
    most = max(kinds.values())
    top = sorted(k for k, n in kinds.items() if n == most)
    return keep if keep in top else top[0]


def _field_name(field: dict) -> str:
    return field["target"] or " ".join(w[:1].upper() + w[1:].lower() for w in field["header"].split())


def compare(old: list[dict], new: list[dict]) -> list[tuple[str, str, str | None, str | None]]:
    """(field, change_kind, header before, header now) of a file against the one before."""
    by_old, by_new = {f["name"]: f for f in old}, {f["name"]: f for f in new}
    gone = sorted(by_old.keys() - by_new.keys())
    come = sorted(by_new.keys() - by_old.keys())
    score = [[s if (s := rename_score(by_old[a], by_new[b])) >= LEAST_RENAME else 0.0 for b in come] for a in gone]
    pairs = {a: come[j] for a, j, row in zip(gone, assign(score), score) if j >= 0 and row[j] > 0}
    out = [(_field_name(by_old[a]), "removed", by_old[a]["header"], None) for a in gone if a not in pairs]
    taken = set(pairs.values())
    out += [(_field_name(by_new[b]), "added", None, by_new[b]["header"]) for b in come if b not in taken]
    out += [(_field_name(by_new[b]), "renamed", by_old[a]["header"], by_new[b]["header"]) for a, b in pairs.items()]
    for a, b in [*pairs.items(), *((n, n) for n in by_old.keys() & by_new.keys())]:
        was = _main_kind(by_old[a])
        now = _main_kind(by_new[b], was)
        if was and now and was != now:
            out.append((_field_name(by_new[b]), "retyped", by_old[a]["header"], by_new[b]["header"]))
    return out


def changes(files: DataFrame, raw: DataFrame, checklist: DataFrame) -> DataFrame:
    """file_id, field, change_kind, header_before, header_now: every change of a file against the one before."""
    counted = profiles(cells(spread(raw.select("raw_id", "file_id", "payload"))))
    return _changes(files, counted, header_targets(counted, checklist))


def _changes(files: DataFrame, counted: DataFrame, target: DataFrame) -> DataFrame:
    entries = lambda when, k: F.map_from_entries(F.collect_list(F.when(when, F.struct(k, "n"))))
    profile = counted.groupBy("file_id", "name").agg(F.min("header").alias("header"), entries(F.col("kind").isNotNull(), "kind").alias("kinds"), entries(F.col("b").isNotNull(), "b").alias("sketch"))
    profile = profile.join(target, "name")
    per_file = profile.groupBy("file_id").agg(F.collect_list(F.struct("name", "header", "target", "kinds", "sketch")).alias("fields"))
    steps = _before(files).where(F.col("prev_id").isNotNull())
    new = per_file.withColumnRenamed("fields", "new")
    old = per_file.select(F.col("file_id").alias("prev_id"), F.col("fields").alias("old"))
    pairs = steps.join(new, "file_id", "left").join(old, "prev_id", "left").select("file_id", "old", "new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"file_id": [], "field": [], "change_kind": [], "header_before": [], "header_now": []}
            for row in batch.to_pylist():
                for change in compare(row["old"] or [], row["new"] or []):
                    for k, x in zip(out, (row["file_id"], *change)):
                        out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("file_id", pa.int64()), *((k, pa.string()) for k in list(out)[1:])]))

    return pairs.mapInArrow(run, "file_id bigint, field string, change_kind string, header_before string, header_now string")


def _same_fields(files: DataFrame, changes_: DataFrame, target: DataFrame) -> DataFrame:
    """template_id, name, key, to_target: the headers of a template that renames tie together, under the name that came first and their only target."""
    renames = changes_.where("change_kind = 'renamed'").select("file_id", name_key(F.col("header_before")).alias("old"), name_key(F.col("header_now")).alias("new"))
    steps = renames.join(files, "file_id").groupBy("template_id", "old", "new").agg(F.min(F.struct("exported_at", "file_id")).alias("at"))
    for c in ("old", "new"):
        steps = steps.join(target.select(F.col("name").alias(c), F.col("target").alias(f"{c}_target")), c)
    steps = steps.select("template_id", "old", "new", "old_target", "new_target", F.col("at.exported_at").alias("exported_at"), F.col("at.file_id").alias("file_id"))
    kind = steps.schema["template_id"].dataType

    def run(group: pa.Table) -> pa.Table:
        first: dict[str, str] = {}
        targets: dict[str, set] = {}

        def root(name: str) -> str:
            while first.setdefault(name, name) != name:
                name = first[name]
            return name

        rows = sorted(group.to_pylist(), key=lambda r: (r["exported_at"], r["file_id"], r["old"], r["new"]))
        for r in rows:
            a, b = root(r["old"]), root(r["new"])
            first[b] = a
        for r in rows:
            targets.setdefault(root(r["old"]), set()).update(t for t in (r["old_target"], r["new_target"]) if t)
        names = list(first)
        only = [next(iter(t)) if len(t := targets[root(n)]) == 1 else None for n in names]
        return pa.table({"template_id": pa.array([rows[0]["template_id"]] * len(names), group.schema.field("template_id").type), "name": pa.array(names, pa.string()), "key": pa.array([root(n) for n in names], pa.string()), "to_target": pa.array(only, pa.string())})

    return steps.groupBy("template_id").applyInArrow(run, f"template_id {kind.simpleString()}, name string, key string, to_target string")


def unified(files: DataFrame, raw: DataFrame, checklist: DataFrame) -> DataFrame:
    """raw_id, file_id, template_id, sheet_row, the target columns as text, and other_fields: one table of all files.

    Headers that were paired as renames inside a template are one field: under the target of either, else in other_fields under
    the name that came first.  Where several headers of a row share a field, the column has the largest value, and the others
    are in other_fields under their own names; a name that is taken gets a number.
    """
    found = cells(spread(raw.select("raw_id", "file_id", "payload")))
    counted = profiles(found)
    target = cut_lineage(header_targets(counted, checklist))
    one = _same_fields(files, _changes(files, counted, target), target)
    typed = found.join(target, "name").join(files.select("file_id", "template_id"), "file_id").join(one, ["template_id", "name"], "left")
    typed = typed.select("raw_id", "name", F.coalesce("target", "to_target").alias("target"), F.coalesce("key", "name").alias("key"), "value")
    columns = [F.max(F.when(F.col("target") == t, F.col("value"))).alias(t) for t in TARGETS]
    # Fields kept under their own first name come before those that were renamed to it.
    listed = F.array_sort(F.collect_set(F.struct("key", (F.col("key") != F.col("name")).alias("moved"), "name", "target", "value"))).alias("listed")
    larger = lambda x: F.exists("listed", lambda y: (y["target"] == x["target"]) & (y["value"] > x["value"]))
    rest = F.transform(F.filter("listed", lambda x: x["target"].isNull() | larger(x)), lambda x: F.struct(F.when(x["target"].isNull(), x["key"]).otherwise(x["name"]).alias("key"), x["value"].alias("value")))
    wide = typed.groupBy("raw_id").agg(*columns, listed).withColumn("rest", F.array_distinct(rest))
    same = lambda x, y: y["key"] == x["key"]
    told = F.filter("rest", lambda x: x["value"].isNotNull() | ~F.exists("rest", lambda y: same(x, y) & y["value"].isNotNull()))
    wide = wide.withColumn("rest", told)
    number = lambda x, i: F.size(F.filter(F.slice("rest", F.lit(1), i), lambda y: same(x, y))) + 1
    numbered = F.transform("rest", lambda x, i: F.struct(F.when(number(x, i) > 1, F.concat(x["key"], F.lit(" "), number(x, i).cast("string"))).otherwise(x["key"]).alias("key"), x["value"].alias("value")))
    wide = wide.withColumn("other_fields", F.map_from_entries(numbered)).drop("listed", "rest")
    head = raw.select("raw_id", "file_id", "sheet_row").join(files.select("file_id", "template_id"), "file_id")
    return head.join(wide, "raw_id", "left")
