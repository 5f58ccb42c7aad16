"""Model output: recovery, normalisation, arbitration, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.boxes import box_from_array
from clauseloom.functions.text import has_content, snippet, strip

K = "contract_id"


def recover_json(responses: DataFrame, raw: str = "raw", name: str = "json", parsed: str | None = None) -> DataFrame:
    """Add the JSON text found in a raw model answer, NULL when none is valid.

    Tried in order: the whole text when it starts an object, the first fenced
    block, the span from the first opening to the last closing brace. Each is
    parsed once, and only where those before failed; ``parsed`` names a column
    to keep the parsed variant in.
    """
    text = strip(raw)
    own = responses.columns
    rows = responses.selectExpr("*", f"{text} AS __t").selectExpr("*", "CASE WHEN startswith(__t, '{') THEN __t END AS __whole")
    rows = rows.selectExpr("*", "try_parse_json(__whole) AS __v1")
    # what stands between the first two fences; later steps are worked out only where those before failed
    opened = "locate('```', __t)"
    closed = f"{opened} > 0 AND locate('```', __t, {opened} + 3) > 0"
    rows = rows.selectExpr("*", f"CASE WHEN __v1 IS NULL AND {closed} THEN split_part(__t, '```', 2) END AS __f")
    rows = rows.selectExpr("*", f"{strip("CASE WHEN startswith(__f, 'json') THEN substring(__f, 5) ELSE __f END")} AS __fenced")
    rows = rows.selectExpr("*", "try_parse_json(__fenced) AS __v2")
    last = "(length(__t) - length(substring_index(__t, '}', -1)))"
    first = "locate('{', __t)"
    span = f"CASE WHEN __v1 IS NULL AND __v2 IS NULL AND {first} > 0 AND {last} > {first} THEN substring(__t, {first}, {last} - {first} + 1) END"
    rows = rows.selectExpr("*", f"{span} AS __braces").selectExpr("*", "try_parse_json(__braces) AS __v3")
    found = (
        "CASE WHEN __v1 IS NOT NULL THEN __whole WHEN __v2 IS NOT NULL THEN __fenced "
        f"WHEN __v3 IS NOT NULL THEN __braces END AS {name}"
    )
    return rows.selectExpr(*own, found, *([f"coalesce(__v1, __v2, __v3) AS {parsed}"] if parsed else []))


_MEMBERS = ("field_key", "field_name", "field_value", "value", "source_text", "source_page", "source_bbox", "confidence")


def _kind(v: str) -> str:
    """JSON type of a variant: NULL where it is missing, 'VOID' for null."""
    return f"schema_of_variant({v})"


def _number(v: str, kind: str) -> str:
    """The number a variant of a known kind stands for: a number, a text of one, or a boolean as 0 or 1; else NULL."""
    return (
        f"CASE {kind} WHEN 'BOOLEAN' THEN CAST(try_variant_get({v}, '$', 'BOOLEAN') AS DOUBLE) "
        f"WHEN 'STRING' THEN try_cast(trim(try_variant_get({v}, '$', 'STRING')) AS DOUBLE) "
        f"WHEN 'VOID' THEN NULL ELSE try_variant_get({v}, '$', 'DOUBLE') END"
    )


#: A field of an answer: its members as variants, taken from the text in one go.
_FIELD = "STRUCT<" + ", ".join(f"{m}: VARIANT" for m in _MEMBERS) + ">"


def _items() -> str:
    """Candidates of an answer as structs of variants, one for each member, with the key they stand under.

    ``listed`` holds the objects of the ``fields`` array; what is no object there is NULL.
    """
    get = ", ".join(f"try_variant_get(x.value, '$.{m}', 'VARIANT') AS {m}" for m in _MEMBERS)
    field_like = " OR ".join(
        f"try_variant_get(t.value, '$.{k}', 'VARIANT') IS NOT NULL" for k in ("field_key", "field_value", "value", "source_text")
    )
    # a variant sorts its members, so the written order comes from the text
    mapped = (
        "filter(map_entries(from_json(json, 'MAP<STRING, VARIANT>')), "
        f"t -> t.key NOT IN ('fields', 'contract_type', 'contract_type_confidence') AND ({field_like}))"
    )
    own = ", ".join(f"x.{m} AS {m}" for m in _MEMBERS)
    return (
        f"CASE WHEN size(listed) > 0 THEN transform(listed, x -> struct(CAST(NULL AS STRING) AS key, x IS NOT NULL AS is_object, {own})) "
        f"ELSE transform({mapped}, x -> struct(x.key AS key, true AS is_object, {get})) END"
    )


def _fields(found: str) -> str:
    """The fields of the candidates ``found``; ``ok`` tells whether every member has a type it may have.

    Steps over the array: each member's kind is looked up once, then each member is converted once, then judged.
    """
    one = [c for c in _MEMBERS if c not in ("field_value", "value", "source_bbox")]
    kinds = ", ".join([*(f"m.{c} AS {c}" for c in _MEMBERS), *(f"{_kind(f'm.{c}')} AS k_{c}" for c in one)])
    value = "CASE WHEN m.field_value IS NOT NULL THEN m.field_value ELSE m.value END"
    typed = f"transform({found}, m -> struct(m.key AS key, m.is_object AS is_object, {kinds}, {_kind(value)} AS k_shown))"
    shown = f"CASE m.k_shown WHEN 'VOID' THEN NULL WHEN 'BOOLEAN' THEN initcap(CAST({value} AS STRING)) ELSE CAST({value} AS STRING) END"
    text = lambda c: f"CASE WHEN m.k_{c} = 'STRING' THEN CAST(m.{c} AS STRING) END"
    absent = lambda c: f"coalesce(m.k_{c} = 'VOID', true)"
    corner = f"transform(try_variant_get(m.source_bbox, '$', 'ARRAY<VARIANT>'), e -> struct(e AS v, {_kind('e')} AS k))"
    texts = " AND ".join(f"coalesce(m.k_{c} IN ('VOID', 'STRING'), true)" for c in ("field_name", "source_text"))
    converted = (
        f"transform({typed}, m -> struct(CASE WHEN m.field_key IS NULL THEN m.key ELSE {text('field_key')} END AS field_key, "
        f"{text('field_name')} AS field_name, {shown} AS value, {text('source_text')} AS source_text, "
        f"{_number('m.source_page', 'm.k_source_page')} AS page, {absent('source_page')} AS no_page, "
        f"transform({corner}, e -> {_number('e.v', 'e.k')}) AS source_bbox, "
        "m.source_bbox IS NULL OR is_variant_null(m.source_bbox) AS no_bbox, "
        f"CASE WHEN m.confidence IS NULL THEN 0.8D ELSE {_number('m.confidence', 'm.k_confidence')} END AS confidence, "
        f"m.is_object AND {texts} AS ok))"
    )
    ok = (
        "f.ok AND f.field_key IS NOT NULL "
        "AND (f.no_page OR coalesce(f.page = floor(f.page) AND abs(f.page) < 2147483648, false)) "
        "AND (f.no_bbox OR coalesce(forall(f.source_bbox, c -> c IS NOT NULL), false)) AND f.confidence IS NOT NULL"
    )
    return (
        f"transform({converted}, f -> struct(f.field_key AS field_key, f.field_name AS field_name, f.value AS value, "
        "f.source_text AS source_text, try_cast(f.page AS INT) AS source_page, f.source_bbox AS source_bbox, "
        f"f.confidence AS confidence, {ok} AS ok))"
    )


def explode_fields(responses: DataFrame) -> DataFrame:
    """One row per field of each answer, in answer order.

    Fields come from the ``fields`` array, or, when that is empty, from
    top-level keys whose object looks like a field; the key then defaults to
    the map key. Every answer is parsed once and read by the same rules:

    * a key must be text; a name and a source text are text or null;
    * a page is a whole number, a box a list of numbers and a confidence a
      number, where texts of numbers and booleans count as numbers;
    * the answer's own type is text or null, its confidence a number.

    A field or answer that breaks a rule rejects its whole answer. Everything
    happens inside the answer's own row; there is no shuffle.
    """
    rows = recover_json(responses, parsed="v").selectExpr(
        K, "chunk_no", "json", "v", f"from_json(json, 'STRUCT<fields: ARRAY<{_FIELD}>>').fields AS listed",
        "try_variant_get(v, '$.contract_type', 'VARIANT') AS t", "try_variant_get(v, '$.contract_type_confidence', 'VARIANT') AS s",
    )
    typed = f"coalesce({_kind('t')} IN ('VOID', 'STRING'), true) AND (s IS NULL OR {_number('s', _kind('s'))} IS NOT NULL)"
    # an array that holds something, but not only objects, is no list of fields
    mixed = "listed IS NULL AND try_variant_get(v, '$.fields[0]', 'VARIANT') IS NOT NULL"
    items = rows.selectExpr(K, "chunk_no", f"CASE WHEN {typed} AND NOT ({mixed}) THEN {_fields(_items())} END AS items")
    whole = "CASE WHEN forall(items, x -> x.ok) THEN items END"
    return items.selectExpr(K, "chunk_no", f"posexplode({whole}) AS (pos, f)").selectExpr(
        K, "chunk_no", "pos", "f.field_key", "f.field_name", "f.value", "f.source_text", "f.source_page",
        "f.source_bbox", "f.confidence",
    )


def response_types(responses: DataFrame) -> DataFrame:
    """Contract type each readable answer reports for itself.

    Unreadable answers go behind a generator: a filter would be pushed below the parsing and parse every answer again.
    """
    rows = recover_json(responses, parsed="v").select(K, "chunk_no", "v")
    own = (
        "struct(try_variant_get(v, '$.contract_type', 'STRING') AS contract_type, "
        "coalesce(try_variant_get(v, '$.contract_type_confidence', 'DOUBLE'), 0D) AS contract_type_confidence)"
    )
    return rows.selectExpr(K, "chunk_no", f"inline(CASE WHEN v IS NOT NULL THEN array({own}) END)")


def type_fields(raw: DataFrame, definitions: DataFrame) -> DataFrame:
    """Raw fields that were requested, with name, type and box settled.

    The definitions side is left to the planner: broadcast when its measured
    size allows, shuffled otherwise.
    """
    defs = definitions.selectExpr("field_key", "field_name AS d_name", "value_type AS d_type")
    return raw.join(defs, "field_key").selectExpr(
        K, "chunk_no", "pos", "field_key",
        "coalesce(nullif(field_name, ''), nullif(d_name, ''), field_key) AS field_name",
        "value", "coalesce(d_type, 'string') AS value_type", "source_text",
        "source_page AS page_no", f"{box_from_array('source_bbox')} AS bbox", "confidence",
    )


def unrequested(raw: DataFrame, definitions: DataFrame) -> DataFrame:
    """Raw fields whose key nobody asked for."""
    return raw.join(definitions.select("field_key"), "field_key", "left_anti")


def merge_fields(chunks: DataFrame) -> DataFrame:
    """Best field per (contract, key) over the chunks.

    Non-empty beats empty, then higher confidence, earlier page (unknown
    last), first seen. The pick is a mergeable aggregate on a sort key, so
    repeated keys shrink before the shuffle.
    """
    filled = has_content("value")
    key = (
        f"struct(CASE WHEN {filled} THEN 0 ELSE 1 END, CASE WHEN {filled} THEN -confidence END, "
        f"CASE WHEN {filled} THEN coalesce(page_no, {2**31 - 1}) END, chunk_no, pos)"
    )
    others = [c for c in chunks.columns if c not in (K, "field_key")]
    best = chunks.groupBy(K, "field_key").agg(F.expr(f"min_by(struct({', '.join(others)}), {key}) AS b"))
    return best.selectExpr(K, "field_key", *[f"b.{c}" for c in others])


def merge_contract_type(types: DataFrame) -> DataFrame:
    """First known contract type in chunk order, with its confidence."""
    pick = "min_by(struct(contract_type, contract_type_confidence), chunk_no)"
    known = "FILTER (WHERE contract_type <> '' AND contract_type <> 'unknown')"
    return types.groupBy(K).agg(F.expr(f"{pick} {known} AS t")).selectExpr(
        K, "t.contract_type", "coalesce(t.contract_type_confidence, 0D) AS contract_type_confidence"
    )


def reconcile(returned: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match returned fields to the requested keys of each contract.

    Returns (fields, failed contracts). Unknown keys go, the last duplicate of
    a key stays, missing keys come in as NULL with confidence 0. A contract
    none of whose requested keys came back fails and yields no fields.
    """
    value_cols = [c for c in returned.columns if c not in (K, "field_key")]
    seen = "chunk_no, pos" if "chunk_no" in value_cols else "pos"
    last = returned.groupBy(K, "field_key").agg(
        F.expr(f"max_by(struct({', '.join(value_cols)}), struct({seen})) AS r")
    )
    both = requested.selectExpr(K, "field_key", "field_name AS d_name", "value_type AS d_type", "sort_order").join(
        last, [K, "field_key"], "left"
    )
    # the contracts that failed follow from the keys alone: no values are gathered for them
    back = returned.select(K, "field_key").distinct().selectExpr("*", "true AS back")
    hits = requested.select(K, "field_key").join(back, [K, "field_key"], "left").groupBy(K).agg(F.expr("count(back) AS hits"))
    failed = hits.filter("hits = 0").select(K)
    shown = both.selectExpr(
        K, "field_key", "coalesce(nullif(r.field_name, ''), d_name) AS field_name", "r.value AS value",
        "coalesce(r.value_type, d_type) AS value_type", "r.source_text AS source_text", "r.page_no AS page_no",
        "r.bbox AS bbox", "coalesce(r.confidence, 0D) AS confidence", "r IS NULL AS missing", "sort_order AS pos",
    )
    # one pass: the answers are not read and merged again to count a contract's hits, and only columns in use are shuffled
    fields = shown.selectExpr("*", f"count_if(NOT missing) OVER (PARTITION BY {K}) AS hits").filter("hits > 0").drop("hits")
    return fields, failed


def extraction_diagnostics(fields: DataFrame, returned: DataFrame, requested: DataFrame) -> DataFrame:
    """Key lists per contract: returned, non-null, null, missing and unknown keys; party summary."""
    empty = "coalesce(value, '') = ''"
    picks = {"returned_keys": "NOT missing", "non_null_keys": f"NOT {empty}", "null_keys": empty, "missing_keys": "missing"}
    lists = [
        F.expr(f"array_join(array_sort(collect_list(field_key) FILTER (WHERE {cond})), ',') AS {name}")
        for name, cond in picks.items()
    ]
    known = fields.groupBy(K).agg(
        *lists,
        F.expr(f"max({snippet('value')}) FILTER (WHERE field_key = 'party-a-name') AS party_a"),
        F.expr(f"max({snippet('value')}) FILTER (WHERE field_key = 'party-b-name') AS party_b"),
    )
    extra = returned.join(requested.select(K, "field_key"), [K, "field_key"], "left_anti").groupBy(K).agg(
        F.expr("array_join(array_sort(collect_set(field_key)), ',') AS unknown_keys")
    )
    return known.join(extra, K, "left").selectExpr(*known.columns, "coalesce(unknown_keys, '') AS unknown_keys")


def upsert_fields(new: DataFrame, old: DataFrame) -> DataFrame:
    """Stored fields with the new ones in place of equal keys.

    New rows start as ``extracted``; an earlier review of a replaced key is gone.
    """
    fresh = new.drop("review_status", "reviewed_value", "reviewer_id", "reviewed_at").selectExpr(
        "*", "'extracted' AS review_status"
    )
    return old.join(new.select(K, "field_key"), [K, "field_key"], "left_anti").unionByName(
        fresh, allowMissingColumns=True
    )


def fields_for_type(contracts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Active definitions that apply to each contract.

    A known type takes the common and its own definitions, an unknown one all.
    Expressed as an equi-join on a scope key, so there is no pairwise theta
    join: a definition offers its own scope and the catch-all one, a contract
    asks for the scopes it needs.
    """
    asked = contracts.selectExpr(
        K,
        "explode(CASE WHEN coalesce(contract_type, 'unknown') IN ('unknown', '') THEN array('any') "
        "ELSE array('common', concat('type:', contract_type)) END) AS scope",
    )
    offered = definitions.filter("is_active").selectExpr(
        "field_key", "field_name", "description", "value_type", "sort_order",
        "explode(array('any', coalesce(concat('type:', contract_type), 'common'))) AS scope",
    )
    return asked.join(offered, "scope").drop("scope")


def effective_field_set(by_type: DataFrame, overrides: DataFrame) -> DataFrame:
    """A contract's own field list replaces the type-driven one."""
    named = overrides.select(K).distinct()
    return by_type.join(named, K, "left_anti").unionByName(overrides, allowMissingColumns=True)


def resolve_type(classified: DataFrame, inline: DataFrame) -> DataFrame:
    """The classifier's type unless unknown, else the one the extraction reported."""
    c = classified.selectExpr(K, "contract_type AS ct", "confidence AS cc")
    i = inline.selectExpr(K, "contract_type AS it", "contract_type_confidence AS ic")
    known = "nullif(nullif(ct, ''), 'unknown') IS NOT NULL"
    return c.join(i, K, "full_outer").selectExpr(
        K,
        f"CASE WHEN {known} THEN ct ELSE nullif(it, '') END AS contract_type",
        f"CASE WHEN {known} THEN cc WHEN nullif(it, '') IS NOT NULL THEN ic END AS contract_type_confidence",
    )
