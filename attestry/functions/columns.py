"""Column expressions over ledger rows. All of them stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V

# -- json ---------------------------------------------------------------------------------------


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def json_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def fields(v: Column) -> Column:
    """An object as a map from field to value (null for anything else). Take it once, as a column of its
    own: looking fields up in it is far cheaper than a path per test."""
    return at(v, "$", "map<string,variant>")


def with_fields(df: DataFrame, text: str | Column, name: str) -> DataFrame:
    """Add the `fields` of a JSON text, parsed once per row: a filter on anything computed from them is
    not pushed below a generated column, where it would parse the text again for every test."""
    text = F.col(text) if isinstance(text, str) else text
    return df.select("*", F.explode(F.array(fields(parsed(text)))).alias(name))


def is_text(v: Column) -> Column:
    return F.coalesce(json_type(v) == "STRING", F.lit(False))


def is_integer(v: Column) -> Column:
    return F.coalesce(json_type(v) == "BIGINT", F.lit(False))


def is_number(v: Column) -> Column:
    return F.coalesce(json_type(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(json_type(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(json_type(v).startswith("ARRAY"), F.lit(False))


def is_uint(v: Column, most: int = V.MAX_SAFE_INT) -> Column:
    return is_integer(v) & at(v, "$", "bigint").between(0, most)


def filled_text(v: Column) -> Column:
    return is_text(v) & (at(v, "$", "string") != "")


def matches(v: Column, pattern: str) -> Column:
    return is_text(v) & at(v, "$", "string").rlike(pattern)


def fields_of(v: Column) -> Column:
    """Field names of an object (empty for anything else)."""
    return F.coalesce(F.when(is_object(v), F.json_object_keys(F.to_json(v))), F.array().cast("array<string>"))


# -- text and time ------------------------------------------------------------------------------


def decode_tag(tag: Column) -> Column:
    """Tag bytes as text; bytes that are not clean UTF-8 without NUL are shown as hex."""
    text = tag.cast("string")
    clean = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\x00"))
    return F.when(clean, text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(tag))))


def label(text: Column, limit: int = V.TITLE_MAX) -> Column:
    """One printable line of at most `limit` characters: white space becomes single spaces, what cannot be
    printed its escape (two hex digits below 256, four above), and a longer line ends in an ellipsis."""
    escape = lambda c: F.format_string("\\%s%s", F.when(F.ascii(c) < 256, "x").otherwise("u"),
                                       F.lpad(F.lower(F.hex(F.ascii(c))), F.when(F.ascii(c) < 256, 2).otherwise(4), F.lit("0")))
    plain = F.regexp_replace(F.translate(text, "\t\n\r", "   "), r"(?U)[\s&&[^\p{C}]]+", " ")
    pieces = F.transform(F.split(plain, r"(?<=\p{C})|(?=\p{C})"), lambda p: F.when(p.rlike(r"^\p{C}$"), escape(p)).otherwise(p))
    line = F.trim(F.when(plain.rlike(r"\p{C}"), F.array_join(pieces, "")).otherwise(plain))
    return F.when(F.char_length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)


def cut_text(text: Column, limit: int = V.TEXT_MAX) -> Column:
    safe = F.replace(text, F.lit("\x00"), F.lit("\\x00"))
    return F.when(F.char_length(safe) <= limit, safe).otherwise(F.concat(F.substring(safe, 1, limit - 3), F.lit("...")))


def cut_items(items: Column, limit: int = V.ITEMS_MAX) -> Column:
    """A list of at most `limit` texts, then how many were left out."""
    more = F.array(F.concat(F.lit("... "), (F.size(items) - limit).cast("string"), F.lit(" more items")))
    short = F.transform(F.slice(items, 1, limit), cut_text)
    return F.when(F.size(items) <= limit, short).otherwise(F.concat(short, more))


def evidence(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def iso(ms: Column) -> Column:
    """Epoch milliseconds as ISO 8601 UTC text; null outside years 1 to 9999."""
    inside = ms.between(-62135596800000, 253402300799999)
    return F.when(inside, F.date_format(F.timestamp_millis(F.when(inside, ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def confirmed_ms(ts: Column) -> Column:
    """Seconds to milliseconds; 0 means "not confirmed"."""
    return F.when(ts != 0, ts * 1000)


def message_date(received_ms: Column, confirmed: Column, ts: Column) -> Column:
    return F.coalesce(received_ms, confirmed, ts * 1000)


def event_time(ts: Column, confirmed: Column, received: Column, window_ms: int = V.WINDOW_MS) -> Column:
    """Ledger-clock time of a message; its receipt time when that lies within one window before."""
    ledger = F.when(ts > 0, ts * 1000).when(confirmed > 0, confirmed)
    return F.when(received.between(ledger - window_ms, ledger), received).otherwise(ledger)


def hex_prefix(text: Column) -> Column:
    """A 32-byte hex link, or null."""
    return F.when(F.lower(text).rlike(V.HEX32), F.lower(text))


def component_key(component: Column) -> Column:
    """Both naming schemes of a service component as one lower-case key."""
    return F.lower(F.regexp_replace(F.trim(component), V.K8S_COMPONENT, "urn:ngsi-ld:Service:$1:Component:$2"))


def strip_urn(ie: Column) -> Column:
    return F.when(ie.startswith(V.IE_URN) & (F.char_length(ie) > len(V.IE_URN)),
                  F.substr(ie, F.lit(len(V.IE_URN) + 1))).otherwise(ie)


# -- kinds, scores, schema ----------------------------------------------------------------------


def kind_of(tag: Column, is_json_object: Column, kinds: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in (kinds or V.KIND_OF_TAG).items() for x in pair])
    return F.when(is_json_object, F.coalesce(table[tag], F.lit(V.UNKNOWN_KIND))).otherwise(F.lit(V.UNKNOWN_KIND))


def score_of(v: Column) -> Column:
    """A JSON value as a trust score: a number in [0, 1], or null (booleans and texts are not)."""
    value = at(v, "$", "double")
    return F.when(is_number(v) & value.between(0, 1), value)


def is_error_code(v: Column) -> Column:
    """Whether a JSON error code reports an error: 0, "0", "" and false do not."""
    kind = json_type(v)
    return F.coalesce(
        F.when(kind == "BOOLEAN", at(v, "$", "boolean"))
        .when(is_number(v), at(v, "$", "double") != 0)
        .when(kind == "STRING", ~F.trim(at(v, "$", "string")).isin("", "0")), F.lit(False))


def ie_of(kind: Column, v: Column) -> Column:
    """The element a body is about, by kind; URN prefix removed."""
    own = at(v, "$.id", "string")
    has = F.array_contains(fields_of(v), "infrastructureElementId")
    ref = F.when(has, at(v, "$.infrastructureElementId")).otherwise(at(v, "$.ieId"))
    target = at(v, "$.infrastructureElementId")
    return (F.when((kind == V.SCORE_KIND) & matches(at(v, "$.id"), V.IE_ID), own)
            .when((kind == V.ORCHESTRATOR_KIND) & filled_text(target), strip_urn(at(target, "$", "string")))
            .when((kind == "self-security") & is_text(ref) & (F.trim(at(ref, "$", "string")) != ""),
                  strip_urn(F.trim(at(ref, "$", "string")))))


def checkpoint_problem(cp: Column) -> Column:
    """The first structural problem of a checkpoint document, or null."""
    # the problem texts are fixed values: stored results are compared with them
    fields = ("v", "kind", "network", "domain", "from", "to", "msRoot", "msgCount", "policyHash", "prev")
    ends = []
    for name in ("from", "to"):
        end = at(cp, f"$.{name}")
        ends += [
            (~is_object(end) | (F.array_sort(fields_of(end)) != F.array(F.lit("id"), F.lit("index"))),
             f"{name} must be {{index, id}}"),
            (~is_uint(at(cp, f"$.{name}.index")), f"{name}.index must be an unsigned integer"),
            (~matches(at(cp, f"$.{name}.id"), V.HEX32), f"{name}.id must be a 32-byte lowercase hex id")]
    prev = at(cp, "$.prev")
    tests = [
        (~is_object(cp), "checkpoint is not an object"),
        (F.array_sort(fields_of(cp)) != F.array_sort(F.array(*[F.lit(f) for f in fields])),
         "checkpoint fields do not match version 1"),
        (~is_uint(at(cp, "$.v")) | (at(cp, "$.v", "bigint") != 1), "not a version 1 checkpoint"),
        (~is_text(at(cp, "$.network")), "network must be a string"),
        (~is_text(at(cp, "$.domain")), "domain must be a string"),
        *ends,
        (at(cp, "$.from.index", "bigint") > at(cp, "$.to.index", "bigint"), "from.index is after to.index"),
        (~matches(at(cp, "$.msRoot"), V.HEX32), "msRoot must be 32-byte lowercase hex"),
        (~matches(at(cp, "$.policyHash"), V.HEX32), "policyHash must be 32-byte lowercase hex"),
        (~is_uint(at(cp, "$.msgCount")), "msgCount must be an unsigned integer"),
        (~F.coalesce(json_type(prev) == "VOID", F.lit(True)) & ~matches(prev, V.HEX32),
         "prev must be null or 32-byte lowercase hex"),
    ]
    return first_problem(tests)


def first_problem(tests: list[tuple[Column, str]]) -> Column:
    """The text of the first test that holds, or null."""
    out = None
    for bad, text in tests:
        out = F.when(bad, F.lit(text)) if out is None else out.when(bad, F.lit(text))
    return out


def body_fits(kind: Column, m: Column) -> Column:
    """Whether a body (its `fields`) follows the schema of its kind; kinds without one accept anything."""
    g = lambda name: m[name]
    has = lambda name: F.map_contains_key(m, name)
    lits = lambda *names: F.array(*[F.lit(n) for n in names])
    known = lambda x, *names: F.size(F.array_except(F.map_keys(x), lits(*names))) == 0
    exact = lambda x, *names: F.array_sort(F.map_keys(x)) == F.array_sort(lits(*names))
    score = score_of(g("score")).isNotNull() & matches(g("id"), V.IE_ID)
    llo = filled_text(g("event")) & filled_text(g("lloId")) & filled_text(g("serviceComponentId"))
    orchestrator = filled_text(g("infrastructureElementId")) & (filled_text(g("errorCode")) | is_integer(g("errorCode")))
    span = fields(g("range"))
    span_ok = span.isNotNull() & known(span, "msFrom", "msTo")
    for end in ("msFrom", "msTo"):
        span_ok = span_ok & (~F.map_contains_key(span, end) | is_uint(span[end], V.MAX_MILESTONE))
    span_ok = span_ok & ~F.coalesce(at(span["msFrom"], "$", "bigint") > at(span["msTo"], "$", "bigint"), F.lit(False))
    report = (known(m, "reportHash", "generatedAt", "range", "ie") & matches(g("reportHash"), V.HEX32)
              & is_uint(g("generatedAt")) & (~has("range") | span_ok) & (~has("ie") | matches(g("ie"), V.IE_ID)))
    rebased = fields(g("rebased"))
    anchor = (exact(m, "seq", "checkpoint", "checkpointHash", "rebased") & is_uint(g("seq"))
              & (at(g("seq"), "$", "bigint") >= 1) & checkpoint_problem(g("checkpoint")).isNull()
              & matches(g("checkpointHash"), V.HEX32) & exact(rebased, "network", "trail", "record", "tx")
              & filled_text(rebased["network"]) & (F.char_length(at(rebased["network"], "$", "string")) <= 64)
              & matches(rebased["trail"], V.HEX32) & is_uint(rebased["record"]) & matches(rebased["tx"], V.BASE58_DIGEST))
    checked = (F.when(kind == V.SCORE_KIND, score).when(kind.isin(*V.LLO_KINDS), llo)
               .when(kind == V.ORCHESTRATOR_KIND, orchestrator)
               .when(kind == "audit.report", report).when(kind == V.ANCHOR_KIND, anchor).otherwise(F.lit(True)))
    needs_object = kind.isin(V.SCORE_KIND, V.ORCHESTRATOR_KIND, "self-security", "audit.report", V.ANCHOR_KIND, *V.LLO_KINDS)
    return F.coalesce(~needs_object | (m.isNotNull() & checked), F.lit(False))


# -- envelopes ----------------------------------------------------------------------------------


def is_envelope(m: Column) -> Column:
    """Whether an object (its `fields`) is a version 1 envelope."""
    return F.coalesce(is_integer(m["w"]) & (at(m["w"], "$", "bigint") == 1) & is_text(m["sig"]), F.lit(False))


def envelope_problem(m: Column) -> Column:
    """The first structural problem of an envelope (its `fields`), as text, or null."""
    # the problem texts are fixed values: stored results are compared with them
    has = lambda n: F.map_contains_key(m, n)
    g = lambda n: m[n]
    att = fields(g("att"))
    mode = at(g("att"), "$.mode", "string")
    texts = lambda arr: F.forall(arr, lambda x: json_type(x) == "STRING")
    bix_ok = is_array(g("bix")) & F.coalesce(texts(at(g("bix"), "$", "array<variant>")), F.lit(True))
    cmt_ok = is_object(g("cmt")) & F.coalesce(texts(F.map_values(fields(g("cmt")))), F.lit(True))
    return first_problem([
        (~is_envelope(m), "not a version 1 envelope"),
        (F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(k) for k in V.ENVELOPE_FIELDS]))) > 0, "unknown top-level field"),
        *[(~is_text(g(n)), f"missing or invalid field: {n}") for n in ("tag", "iss", "kid")],
        (~is_uint(g("seq")) | ~is_uint(g("iat")), "missing or invalid field: seq/iat"),
        (~matches(g("nonce"), V.NONCE), "invalid nonce encoding"),
        (~matches(g("sig"), V.SIGNATURE), "invalid sig encoding"),
        (att.isNull() | ~F.coalesce(is_text(att["mode"]) & mode.isin("producer", "relay"), F.lit(False)),
         "missing or invalid field: att"),
        ((mode == "relay") & ~filled_text(att["sub"]), "relay attestation requires att.sub"),
        (F.map_contains_key(att, "sub") & ~is_text(att["sub"]), "invalid field: att.sub"),
        (has("body") == has("enc"), "exactly one of body or enc is required"),
        (has("body") & ~is_object(g("body")) & (json_type(g("body")) != "VOID"), "invalid field: body"),
        (has("enc") & ~is_object(g("enc")), "invalid field: enc"),
        (has("bix") & ~bix_ok, "invalid field: bix"),
        (has("cmt") & ~cmt_ok, "invalid field: cmt"),
        (has("prev") & ~matches(g("prev"), V.HEX32), "invalid field: prev"),
        (has("corr") & ~is_text(g("corr")), "invalid field: corr"),
    ])


def is_sealed(m: Column) -> Column:
    return is_envelope(m) & F.map_contains_key(m, "enc") & ~F.map_contains_key(m, "body")


def relay_sealed(posted: Column, sent: Column) -> Column:
    """The relay sealed a legacy message: posted bytes are sealed, what was sent is no envelope."""
    return F.coalesce(is_sealed(fields(posted)), F.lit(False)) & ~is_envelope(fields(sent))


def blind_tokens(v: Column) -> Column:
    """Usable blind-index tokens of an envelope, first occurrence of each, in order."""
    every = F.coalesce(at(v, "$.bix", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(every, lambda x: json_type(x) == "STRING"), lambda x: x.cast("string"))
    good = F.filter(texts, lambda s: (s != "") & ~F.contains(s, F.lit("\x00")))
    return F.array_distinct(good)


# -- predicates ---------------------------------------------------------------------------------


def proven(verdict: Column) -> Column:
    return F.coalesce(verdict.isin(*V.PROVEN_VERDICTS), F.lit(False))


def claims_issuer(iss: Column, verdict: Column) -> Column:
    return iss.isNotNull() & ~proven(verdict)


def clock_skewed(iat: Column, ts: Column, limit_s: int = V.SKEW_S) -> Column:
    return iat.isNotNull() & (ts > 0) & (F.abs(iat - ts * 1000) > limit_s * 1000)


def valid_through_second(revoked_at_ms: Column, ts: Column) -> Column:
    return revoked_at_ms.isNull() | (revoked_at_ms >= (ts + 1) * 1000)


def solid_ok(is_solid: Column, state: Column) -> Column:
    return F.when(is_solid.isNotNull(), is_solid & F.coalesce(state != "conflicting", F.lit(True)))


def severity_rank(severity: Column) -> Column:
    out = F.lit(-1)
    for name, rank in V.SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def worse(a: Column, b: Column) -> Column:
    """The more severe of two severities; the first on a tie."""
    return F.when(a.isNull(), b).when(b.isNull(), a).when(severity_rank(a) >= severity_rank(b), a).otherwise(b)


def verdict_family(verdict: Column) -> Column:
    return F.when(proven(verdict), "signed").when(verdict == V.UNSIGNED, "unsigned").otherwise("rejected")


def signature_required(require: Column, grace: Column) -> Column:
    return require & ~grace


def may_write(allowed: Column, iss: Column) -> Column:
    return F.coalesce(F.array_contains(allowed, "*") | F.array_contains(allowed, iss), F.lit(False))


def first_difference(a: Column, b: Column) -> Column:
    """Offset of the first differing byte of two byte strings (the shorter length if none)."""
    a, b = a.cast("binary"), b.cast("binary")
    shorter = F.least(F.octet_length(a), F.octet_length(b))
    at_ = F.array_position(
        F.transform(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))),
                    lambda i: F.substring(a, i, 1) != F.substring(b, i, 1)), True)
    return F.when((shorter == 0) | (at_ == 0), shorter.cast("bigint")).otherwise((at_ - 1).cast("bigint"))


def trust_of_event(trust: Column, revoked: Column) -> Column:
    word = revoked.rlike(r"^[A-Za-z0-9 _.:-]{1,40}$")
    return (F.when(word, "revoked").when(trust.isin("proven", "relayed", "untrusted"), trust).otherwise("unknown"))
