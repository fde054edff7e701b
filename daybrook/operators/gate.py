"""The privacy gate: what may be stored, and in which form.

Cheap tests come first: rows outside the allowlist and dropped clips are gone before any
redaction expression runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CONTENT_KEYS, GATE_VERSION, POSIX_HOME, WINDOWS_HOME
from ..functions.core import bind, has_text, non_null, once, strings
from ..functions.paths import ancestors, lexical
from ..functions.secrets import ANY_SECRET, clipboard_preview, clipboard_summary, scrub
from ..model import EVENT, PAYLOAD_TYPE
from .diffs import BODY, DIFFSTAT, PREVIEW, CapturePolicy, capture_diff

_ANY = "|".join(("(?:" + WINDOWS_HOME + ")", "(?:" + POSIX_HOME + ")", ANY_SECRET))


# --- allowlist ------------------------------------------------------------------

def gated_path() -> Column:
    """The path that decides, for the two types that have one."""
    return F.when(F.col("type") == "FILE_CHANGE", F.col("payload.path")) \
        .when(F.col("type") == "GIT_COMMIT", F.col("payload.repo"))


def inline_allowed(path: Column, roots: list[str], ignore_case: bool = False) -> Column:
    """Path equal to or below one of the roots (a list known on the driver)."""
    forms = sorted({r if not ignore_case else r.lower() for r in map(_plain_root, roots) if r})
    below = F.concat(lexical(path, ignore_case=ignore_case), F.lit("/"))
    return bind(below, lambda p: F.exists(strings(r.rstrip("/") + "/" for r in forms), lambda r: F.startswith(p, r)))


def _plain_root(root: str) -> str:
    flat = root.replace("\\", "/")
    parts: list[str] = []
    for s in flat.split("/"):
        if s == "..":
            parts = parts[:-1]
        elif s not in ("", "."):
            parts.append(s)
    return ("/" if flat.startswith("/") else "") + "/".join(parts)


def allowed_paths(paths: DataFrame, roots: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Distinct ``path`` values under any ``root``, for root tables of any size.

    Each distinct path is unfolded to its ancestors, which turns the prefix test into an
    equi semi join; Spark broadcasts the roots only when their size allows it.
    """
    steps = paths.select("path").distinct().select(
        "path", F.explode(ancestors(lexical("path", ignore_case=ignore_case))).alias("ancestor"))
    plain = roots.select(lexical("root", ignore_case=ignore_case).alias("ancestor")).distinct()
    return steps.join(plain, "ancestor", "left_semi").select("path").distinct()


def with_allowed(events: DataFrame, roots, ignore_case: bool = False) -> DataFrame:
    """Add ``_allowed``.  ``roots`` is a list that travels in the plan, or a table with a ``root`` column, of any size."""
    path = gated_path()
    if isinstance(roots, DataFrame):
        keyed = events.withColumn("_path", path)
        ok = allowed_paths(keyed.where(has_text("_path")).select(F.col("_path").alias("path")), roots, ignore_case)
        ok = ok.select(F.col("path").alias("_path"), F.lit(True).alias("_ok"))
        return keyed.join(ok, "_path", "left").withColumn("_allowed", F.coalesce("_ok", F.lit(False))).drop("_path", "_ok")
    return events.withColumn("_allowed", F.coalesce(inline_allowed(path, list(roots), ignore_case), F.lit(False)))


# --- redaction of whole payloads -------------------------------------------------

class _Layout:
    """Where each text of a nested type sits in one flat array.

    Single texts come first at fixed places, then the lists one after the other.  One flat
    array means one scrub expression in the plan, however many fields a payload has.
    """

    def __init__(self, dtype: T.DataType):
        self.dtype = dtype
        self.single: list = []
        self.lists: list = []
        self._collect(lambda v: v, dtype)

    def _collect(self, get, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StringType):
            self.single.append(get)
        elif isinstance(dtype, T.StructType):
            for f in dtype.fields:
                self._collect(lambda v, n=f.name: get(v)[n], f.dataType)
        elif isinstance(dtype, T.MapType):
            self.lists.append(lambda v: F.map_values(get(v)))
        elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            for f in dtype.elementType.fields:
                self.lists.append(lambda v, n=f.name: F.transform(get(v), lambda e: e[n]))
        elif isinstance(dtype, T.ArrayType):
            self.lists.append(get)

    def flat(self, value: Column) -> Column:
        lists = [F.coalesce(g(value), strings([])) for g in self.lists]
        return F.concat(F.array(*[g(value) for g in self.single]), *lists)

    def rebuild(self, value: Column, texts: Column) -> Column:
        """The nested value with the flat texts put back in their places."""
        singles, lists = iter(range(1, len(self.single) + 1)), iter(range(len(self.lists)))
        sizes = [F.coalesce(F.size(g(value)), F.lit(0)) for g in self.lists]
        sizes = [F.greatest(n, F.lit(0)) for n in sizes]

        def part() -> Column:
            i = next(lists)
            start = F.lit(len(self.single) + 1)
            for n in sizes[:i]:
                start = start + n
            return F.slice(texts, start, sizes[i])

        def build(v: Column, dtype: T.DataType) -> Column:
            if isinstance(dtype, T.StringType):
                return texts[next(singles) - 1]
            if isinstance(dtype, T.StructType):
                return F.when(v.isNotNull(), F.struct(*[build(v[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
            if isinstance(dtype, T.MapType):
                return F.when(v.isNotNull(), F.map_from_arrays(F.map_keys(v), part()))
            if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
                return F.when(v.isNotNull(), F.arrays_zip(*[part().alias(f.name) for f in dtype.elementType.fields])
                              .cast(dtype))
            if isinstance(dtype, T.ArrayType):
                return F.when(v.isNotNull(), part())
            return v
        return build(value, self.dtype)


def scrub_nested(value: Column, dtype: T.DataType) -> Column:
    """``struct<clean, names>``: every text in a nested value scrubbed, keys untouched.

    Most payloads hold nothing to hide; one test over the joined texts lets them pass as
    they are.  The walk follows the schema, so it is plain expressions for the optimiser.
    """
    layout = _Layout(dtype)

    def walk(v: Column, texts: Column) -> Column:
        def put_back(done: Column) -> Column:
            # bound, or every field of the payload would walk over all texts again
            return F.struct(
                bind(F.transform(done, lambda d: d["text"]), lambda t: layout.rebuild(v, t)).alias("clean"),
                F.array_sort(F.array_distinct(F.flatten(F.transform(
                    F.filter(done, lambda d: d.isNotNull()), lambda d: d["names"])))).alias("names"))
        return bind(F.transform(texts, lambda t: F.when(t.isNotNull(), scrub(t))), put_back)

    def run(b: Column) -> Column:
        untouched = F.struct(b["value"].alias("clean"), strings([]).alias("names"))
        return F.when(F.array_join(b["texts"], "\n").rlike(_ANY), walk(b["value"], b["texts"])).otherwise(untouched)

    return bind(value, lambda v: bind(F.struct(v.alias("value"), layout.flat(v).alias("texts")), run))


# --- the gate ----------------------------------------------------------------------

def gate(events: DataFrame, roots, *, passed_at: str, policy: CapturePolicy = CapturePolicy(),
         ignore_case: bool = False) -> DataFrame:
    """Judge every row.  Adds ``drop_reason`` (null when kept) and ``diff_clean``.

    Order: allowlist, clipboard typing, capture of body/diffstat/diff where the policy and
    the type allow it, removal of raw content, scrubbing of all other texts, audit stamp.
    A dropped row keeps only its id, type and reason.
    """
    kind = F.col("type")
    path = gated_path()
    clip = F.when(kind == "CLIPBOARD", clipboard_summary(F.col("payload.content")))
    reason = F.when(kind.isin("FILE_CHANGE", "GIT_COMMIT"), F.when(~has_text(path), F.lit("missing_path")).when(
        ~F.col("_allowed"), F.lit("not_in_allowlist"))).when(
        F.col("_clip.kind") == "credential", F.lit("clipboard_credential"))
    judged = once(once(with_allowed(events, roots, ignore_case), _clip=clip), drop_reason=reason)

    keep = F.col("drop_reason").isNull()
    p = F.col("payload")
    first_party = kind.isin("FILE_CHANGE", "GIT_COMMIT") & F.lit(policy.capture_diffs)
    is_clip = kind == "CLIPBOARD"
    body_kept = first_party & has_text(p["body"])
    stat_kept = first_party & has_text(p["diffstat"])
    stripped = F.lit(False)
    for key in CONTENT_KEYS:
        present = p[key].isNotNull()
        if key == "body":
            present = present & ~body_kept
        if key == "content":
            present = present & ~is_clip
        if key == "diff":
            present = present & ~(first_party & has_text(p["diff"]))
        stripped = stripped | present
    preview = clipboard_preview(p["content"], policy.clipboard_preview_chars) if policy.clipboard_preview \
        else F.lit(None).cast("string")
    captured = capture_diff(p["diff"], policy) if policy.capture_diffs else F.lit(None).cast(
        "struct<clean:string,lines:int,truncated:boolean,codes:array<string>>")
    codes = non_null(
        F.when(is_clip, F.lit("clipboard_typed")), F.when(body_kept, F.lit(BODY)),
        F.when(stat_kept, F.lit(DIFFSTAT)), F.when(stripped, F.lit("content_stripped")))
    staged = once(judged, _preview=F.when(keep & is_clip, preview), _diff=F.when(keep & first_party, captured),
                  _codes=codes, _body_kept=body_kept)

    shaped = {f.name: p[f.name] for f in PAYLOAD_TYPE.fields}
    for key in CONTENT_KEYS:
        shaped[key] = F.when(F.col("_body_kept"), p["body"]) if key == "body" else F.lit(None).cast("string")
    shaped["kind"] = F.when(is_clip, F.col("_clip.kind")).otherwise(p["kind"])
    shaped["length"] = F.when(is_clip, F.col("_clip.length").cast("string")).otherwise(p["length"])
    shaped["host"] = F.coalesce(F.col("_clip.host"), p["host"])
    shaped["preview"] = F.coalesce(F.col("_preview"), p["preview"])
    shaped["diff_lines"] = F.coalesce(F.col("_diff.lines").cast("string"), p["diff_lines"])
    shaped["diff_truncated"] = F.coalesce(F.col("_diff.truncated").cast("string"), p["diff_truncated"])
    payload = F.struct(*[shaped[f.name].alias(f.name) for f in PAYLOAD_TYPE.fields])
    extras_type = EVENT["extras"].dataType
    both = T.StructType([T.StructField("payload", PAYLOAD_TYPE), T.StructField("extras", extras_type)])
    whole = F.struct(payload.alias("payload"), F.col("extras").alias("extras"))
    scrubbed = once(staged, _s=F.when(keep, scrub_nested(whole, both)))

    no_codes = strings([])
    codes = F.array_sort(F.array_distinct(F.concat(
        F.col("_codes"), F.coalesce("_s.names", no_codes), F.coalesce("_diff.codes", no_codes),
        F.when(F.col("_preview").isNotNull(), F.array(F.lit(PREVIEW))).otherwise(no_codes))))
    diff_clean = F.col("_diff.clean")
    stamped = F.struct(F.lit(GATE_VERSION).alias("gate_version"), codes.alias("redactions"),
                       F.lit(passed_at).alias("passed_at"))
    ref = F.col("_s.clean.payload").withField("diff_ref", F.coalesce(F.sha2(diff_clean, 256), F.col("_s.clean.payload.diff_ref")))
    out = {
        "payload": F.when(diff_clean.isNotNull(), ref).otherwise(F.col("_s.clean.payload")),
        "extras": F.col("_s.clean.extras"),
        "privacy": F.when(keep, stamped),
        "diff_clean": diff_clean,
    }
    others = [c for c in events.columns if c not in out]
    return scrubbed.select(*others, *[v.alias(k) for k, v in out.items()], "drop_reason")


def kept(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("drop_reason").isNull()).drop("drop_reason")


def dropped(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("drop_reason").isNotNull()).select("event_id", "type", "drop_reason")


def gate_counts(gated: DataFrame) -> DataFrame:
    """``measure, name, n``: rows written, dropped by reason, and redactions by code."""
    written = F.struct(F.lit("written").alias("measure"), F.lit("").alias("name"))
    drop = F.struct(F.lit("dropped").alias("measure"), F.col("drop_reason").alias("name"))
    codes = F.transform(F.coalesce("privacy.redactions", strings([])), lambda c: F.struct(
        F.lit("redaction").alias("measure"), c.alias("name")))
    facts = F.when(F.col("drop_reason").isNull(), F.concat(F.array(written), codes)).otherwise(F.array(drop))
    return gated.select(F.explode(facts).alias("f")).groupBy("f.measure", "f.name").agg(F.count("*").alias("n"))


# --- egress ------------------------------------------------------------------------

def rescrub(events: DataFrame) -> DataFrame:
    """Second, independent pass over the payload before rows leave."""
    both = T.StructType([EVENT["payload"], EVENT["extras"]])
    again = once(events, _s=scrub_nested(F.struct("payload", "extras"), both))
    return again.withColumn("payload", F.col("_s.clean.payload")).withColumn("extras", F.col("_s.clean.extras")).drop("_s")


def sendable(events: DataFrame) -> DataFrame:
    """Only rows with a privacy stamp leave, scrubbed again."""
    return rescrub(events.where(F.col("privacy").isNotNull()))


def blocked(events: DataFrame) -> DataFrame:
    return events.where(F.col("privacy").isNull()).select(F.coalesce("event_id", F.lit("?")).alias("event_id"))
