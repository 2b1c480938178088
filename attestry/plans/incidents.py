"""Incident correlation: observations, components, sessions, recovery, quiet close, retraction, alert links.

Columns decide what each message or alert means. Observations that can meet share a correlation key (an element, a component, an
issuer) or a block, directly or through others, within the time an incident can stay open: Spark finds these temporal connected
components (`place`), and each is folded in order by a small state machine. Nothing outside its component can change an incident.

Trust is judged as things were when a message arrived. An alert that takes a block's trust away later is an observation of its own
("distrust"): the block's event becomes evidence, an incident it closed reopens, and the recovery target follows from what is left.
The changes are a log; `memberships` reads it as rows with a sign, so that the events of an incident are a sum.

An incident that saw no event for `quiet_ms` of ledger time is closed before the next observation is looked at. That bounds what an
observation can influence. `advance` folds a batch of observations onto the books kept by earlier ones: the whole ledger is one such
batch (`correlate`), a stream is many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocabulary as V
from ..operators import documents, graph, ordered, scores
from ..session import settle

LLO_FAILED = "service component failed"
LEDGER = "ledger"


@dataclass(frozen=True)
class Settings:
    window_ms: int = V.WINDOW_MS
    quiet_ms: int = V.QUIET_MS
    drop: float = V.DROP
    security_tags: tuple[str, ...] = ("self-security",)
    hindsight: bool = False  # a block distrusted at any time never counts, instead of being taken back
    keep_ms: int = 86_400_000  # how long a stream remembers a closed incident whose blocks may yet be distrusted


# One observation. `ord_ms` and the columns after it give the order of processing.
OBSERVATION = ("primary string, ord_ms bigint, ms_index bigint, wf_index bigint, rank int, alert_id bigint, block_id string,"
               " at_ms bigint, role string, level string, opens boolean, finding boolean, severity string, title string,"
               " ie_id string, keys array<string>, score double, base double, base_block string, is_drop boolean, rule string, link_only boolean, pending boolean")
COLUMNS = [c.strip().split(" ")[0] for c in OBSERVATION.split(",")]
ORDER = ("ord_ms", "ms_index", "wf_index", "block_id", "rank", "alert_id")


def _keys(ie: Column, sc_key: Column, host: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(F.concat(F.lit("ie:"), ie), F.concat(F.lit("sc:"), sc_key), F.concat(F.lit("ie:"), host))))


def _grave() -> Column:
    return F.coalesce(F.col("severity").isin("critical", "high"), F.lit(False))


def _late(at_ms: str, ts: str, s: Settings) -> Column:
    """Whether an alert that takes a block's trust away came after the block was looked at."""
    return F.lit(not s.hindsight) & F.coalesce(F.col(at_ms) > F.col(ts) * 1000, F.lit(False))


def _doubts(alerts: DataFrame, s: Settings) -> DataFrame:
    """Per block whether a grave alert names it (`alerted`), and of the alerts that take its trust away: whether one counts from
    the start (`_at_once`), and the first and last time of those that count from the start or come late, as the block's time decides."""
    doubt = F.coalesce(F.col("rule").isin(*V.DISTRUST_RULES), F.lit(False))
    when = F.when(doubt & _grave(), F.col("at_ms"))
    return alerts.filter("block_id IS NOT NULL").groupBy("block_id").agg(
        F.bool_or(_grave()).alias("alerted"), F.bool_or(doubt & when.isNull()).alias("_at_once"), F.min(when).alias("_first"), F.max(when).alias("_last"))


SUBJECT = ("block_id", "tag", "kind", "verdict", "iss", "ie_id", "service", "score", "error_code", "ms_index", "wf_index", "ts", "confirmed_at_ms", "received_at_ms")


def _subjects(messages: DataFrame, policy: DataFrame, alerts: DataFrame, submissions: DataFrame, hosts: DataFrame, s: Settings) -> DataFrame:
    """Messages with trust, event time, subject element, component and host, and trusted previous scores."""
    # of the body only one fact is asked; texts and hashes that nothing asks for stay behind
    event = F.lower(F.trim(F.get_json_object("json", "$.event")))
    slim = messages.select(*SUBJECT, (F.col("kind").isin(*V.LLO_KINDS) & F.coalesce(event == LLO_FAILED, F.lit(False))).alias("failed"))
    slim = slim.withColumn("sc_key", C.component_key(F.when(F.col("kind").isin(*V.LLO_KINDS), F.col("service"))))
    # written down, so that Spark knows its size: a small one moves to the messages, not they to it
    table = settle(hosts.select(C.component_key(F.col("service")).alias("sc_key"), F.col("host_ie")).dropDuplicates(["sc_key"]), "hosts")
    slim = slim.join(table, "sc_key", "left").withColumn("subject", F.coalesce("ie_id", "host_ie"))
    # all that is asked of a block by its id, in one place: alerts, then submissions
    df = slim.join(_doubts(alerts, s), "block_id", "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))
    early = F.col("_first").isNotNull() & ~_late("_first", "ts", s)
    df = df.withColumns({"distrusted": F.coalesce("_at_once", F.lit(False)) | early, "pending": _late("_last", "ts", s)}).drop("_at_once", "_first", "_last")
    df = scores.trusted_flags(df, policy, None, submissions)
    # a score distrusted at any time is nothing to compare others with
    df = df.withColumns({c: F.col(c) & ~F.col("pending") for c in ("ref_proven", "ref_relayed")})
    df = df.withColumn("at_ms", C.event_time(F.col("ts"), F.col("confirmed_at_ms"), F.col("received_at_ms"), s.window_ms))
    # what is not trusted counts for nothing and is no reference; only an alert may ask about it
    df = df.filter("trust <> 'untrusted' OR alerted").drop("verdict", "confirmed_at_ms", "received_at_ms", "may_write", "signature_required", "distrusted", "submitted")
    # references are scores of the subject; rows without one are kept apart from the scan
    named = df.filter("subject IS NOT NULL").withColumn("_own", F.col("ie_id")).withColumn("ie_id", F.col("subject"))
    value = F.struct(F.col("score").alias("score"), F.col("block_id").alias("block"))
    sizes = slim.filter("subject IS NOT NULL").select(F.col("subject").alias("ie_id"), "ms_index", "wf_index")
    named = ordered.scan(named, ["ie_id"], ordered.BY_POSITION, {
        "_p": ordered.last(value, F.col("ref_proven")), "_r": ordered.last(value, F.col("ref_relayed"))}, sizes=sizes)
    named = named.withColumn("ie_id", F.col("_own")).drop("_own")
    return named.unionByName(df.filter("subject IS NULL"), allowMissingColumns=True)


def message_observations(subjects: DataFrame, s: Settings) -> DataFrame:
    """What each trusted message means for the incidents; messages that mean nothing are left out."""
    kind, proven = F.col("kind"), F.col("trust") == "proven"
    is_score = (kind == V.SCORE_KIND) & F.col("ie_id").isNotNull() & F.col("score").between(0, 1)
    error = (kind == V.ORCHESTRATOR_KIND) & F.col("ie_id").isNotNull()
    bad_code = F.coalesce(F.col("error_code") != 0, F.lit(False))
    security = ~error & F.col("tag").isin(*s.security_tags) & F.col("ie_id").isNotNull()
    llo = kind.isin(*V.LLO_KINDS) & F.col("sc_key").isNotNull()
    failed = llo & F.col("failed")
    ref = F.when(proven, F.col("_p")).otherwise(F.col("_r"))
    drop = is_score & F.coalesce(ref["score"] - F.col("score") >= s.drop - V.EPS, F.lit(False))
    role = (F.when(drop, "trust-drop").when(is_score & proven, "score").when(error & bad_code, "security").when(error & proven, "remediation")
            .when(security, "security").when(failed | (llo & proven), "deployment"))
    opens = drop | (error & bad_code) | security | failed
    severity = F.when(drop | security, "high").when(opens, "medium")
    ie = F.col("subject")
    title = (F.when(drop, F.format_string("%s: score fell by %.2f to %.2f", ie, ref["score"] - F.col("score"), F.col("score")))
             .when(error, F.format_string("%s: error code %s", ie, F.col("error_code").cast("string")))
             .when(security, F.concat(ie, F.lit(": security notice")))
             .when(llo, F.concat(F.coalesce("host_ie", F.lit("no known host")), F.lit(": "), F.col("service"), F.lit(" is down"))))
    base = F.when(drop, ref).when(proven, F.col("_p"))
    keys = _keys(F.col("ie_id"), F.col("sc_key"), F.col("host_ie"))
    out = subjects.filter(F.col("trust") != "untrusted").select(
        F.col("ts").alias("_ts"), "ms_index", "wf_index", "block_id", "at_ms", role.alias("role"), F.col("trust").alias("level"), opens.alias("opens"),
        severity.alias("severity"), C.label(title).alias("title"), ie.alias("ie_id"), keys.alias("keys"),
        F.when(is_score, F.col("score")).alias("score"), base["score"].alias("base"), base["block"].alias("base_block"), drop.alias("is_drop"), "pending")
    out = out.filter("role IS NOT NULL")
    return _complete(out.withColumn("rank", F.lit(0)).withColumn("ord_ms", F.col("_ts") * 1000))


def _complete(df: DataFrame) -> DataFrame:
    fields = {c.strip().split(" ")[0]: c.strip().split(" ", 1)[1] for c in OBSERVATION.split(",")}
    filled = {"alert_id": F.lit(-1), "finding": F.lit(False), "link_only": F.lit(False), "pending": F.lit(False)}
    ie = F.get(F.filter("keys", lambda k: k.startswith("ie:")), F.lit(0))
    df = df.withColumn("primary", F.coalesce(ie, F.get("keys", F.lit(0))))
    return df.select(*[(F.col(n) if n in df.columns else filled.get(n, F.lit(None))).cast(t).alias(n) for n, t in fields.items()])


def alerts_on_blocks(alerts: DataFrame, subjects: DataFrame, s: Settings) -> DataFrame:
    """Critical and high alerts with what is known of their block, and whether they take its trust away `late`."""
    hot = alerts.filter(_grave()).select(
        F.col("id").alias("alert_id"), "rule", "severity", "block_id", F.col("ie_id").alias("alert_ie"), F.col("at_ms").alias("alert_ms"))
    m = subjects.filter("alerted").select("block_id", F.col("ts").alias("_ts"), "ms_index", "wf_index", "at_ms", "trust", "ie_id", "iss", "sc_key", "host_ie", "_p")
    late = F.coalesce(F.col("rule").isin(*V.DISTRUST_RULES), F.lit(False)) & _late("alert_ms", "_ts", s)
    return hot.join(m, "block_id", "left").withColumn("late", late)


def alert_observations(df: DataFrame, known: DataFrame) -> DataFrame:
    """What each alert that is not late means (`df` of `alerts_on_blocks`). Alerts on a block are looked at right after the block."""
    df = df.filter(~F.col("late"))
    df = df.withColumn("ie", F.coalesce("alert_ie", "ie_id")).withColumn("target", F.coalesce("ie", "host_ie"))
    df = documents.flag(df, "target", known.select(F.col("ie_id").alias("target")), "resolvable")
    integrity, attack = F.col("rule").isin(*V.INTEGRITY_RULES), F.col("rule").isin(*V.ATTACK_RULES)
    trust = F.coalesce("trust", F.lit("untrusted"))
    level = F.when(integrity, "untrusted").otherwise(trust)
    own = _keys(F.col("ie"), F.col("sc_key"), F.col("host_ie"))
    own = F.when(F.size(own) > 0, own).when(F.col("iss").isNotNull(), F.array(F.concat(F.lit("iss:"), "iss"))).otherwise(own)
    aimed = ~integrity & attack & (level == "untrusted") & F.col("resolvable")
    keys = (F.when(integrity, F.array(F.coalesce(F.concat(F.lit("ie:"), "alert_ie"), F.lit(LEDGER))))
            .when(aimed, F.array(F.concat(F.lit("ie:"), "target"))).otherwise(own))
    keep = integrity | (level != "untrusted") | attack
    # an integrity alert without element still belongs to whatever incident holds its block: it visits the
    # block's own group first, and opens a ledger incident only if nothing holds it there
    visits = integrity & F.col("alert_ie").isNull() & F.col("ms_index").isNotNull() & (F.size(own) > 0)
    subject = F.coalesce("ie", F.concat(F.lit("block "), F.substring("block_id", 1, 14)), F.lit(LEDGER))
    title = F.concat(subject, F.lit(": "), F.lower(F.replace("rule", F.lit("_"), F.lit(" "))))
    ord_ms = F.coalesce(F.col("_ts") * 1000, F.floor(F.col("alert_ms") / 1000) * 1000)
    out = df.filter(keep).select(
        ord_ms.alias("ord_ms"), F.coalesce("ms_index", F.lit(2**62)).alias("ms_index"), F.coalesce("wf_index", F.lit(0)).alias("wf_index"), F.lit(1).alias("rank"), "alert_id",
        "block_id", F.coalesce("at_ms", "alert_ms").alias("at_ms"), F.lit("alert").alias("role"), level.alias("level"),
        (integrity | (level != "untrusted") | aimed).alias("opens"), (integrity | aimed).alias("finding"), "severity", C.label(title).alias("title"),
        F.coalesce(F.when(integrity, F.col("alert_ie")).otherwise(F.coalesce("ie", "host_ie"))).alias("ie_id"),
        F.when(visits, own).otherwise(keys).alias("keys"), F.col("_p.score").alias("base"), F.col("_p.block").alias("base_block"),
        F.lit(False).alias("is_drop"), "rule", visits.alias("link_only"))
    return _complete(out.filter(F.size("keys") > 0))


def plain_observations(messages: DataFrame, severity: str = "medium") -> DataFrame:
    """Messages as events that open incidents and are gathered by element and issuer, their ledger time taken as it is."""
    level = F.when(F.col("verdict") == "PRODUCER_SIGNED", "proven").otherwise("relayed")
    keys = F.array_compact(F.array(F.concat(F.lit("ie:"), "ie_id"), F.concat(F.lit("iss:"), "iss")))
    return _complete(messages.select(
        (F.col("ts") * 1000).alias("ord_ms"), (F.col("ts") * 1000).alias("at_ms"), "ms_index", "wf_index", F.lit(0).alias("rank"), "block_id", F.lit("security").alias("role"),
        level.alias("level"), F.lit(True).alias("opens"), F.lit(severity).alias("severity"), C.label(F.col("tag")).alias("title"), "ie_id", keys.alias("keys"), F.lit(False).alias("is_drop")))


def distrust_observations(late: DataFrame, counted: DataFrame) -> DataFrame:
    """A late alert on a block that counted, at the alert's own time. `counted` are the observations of messages."""
    block = counted.filter("pending").select("block_id", "ie_id", "keys")
    clock = F.floor(F.col("at_ms") / 1000) * 1000
    rows = late.select("block_id", "alert_id", "rule", "severity", F.col("alert_ms").alias("at_ms")).withColumn("ord_ms", clock).join(block, "block_id")
    return _complete(rows.withColumns({"ms_index": F.lit(2**62), "wf_index": F.lit(0), "rank": F.lit(2), "role": F.lit("distrust"), "level": F.lit("untrusted"),
                                       "opens": F.lit(False), "is_drop": F.lit(False), "title": F.lit(None).cast("string")}))


# -- temporal components ----------------------------------------------------------------

BLOCK_LINK = "block:"
BOOK = "keys array<string>, last_ms bigint, state string"


def _runs(held: DataFrame, reach: int) -> DataFrame:
    """(oid, run, key, ord_ms): the stretches of each key without a pause beyond `reach`; those of a block never end, and go without their key."""
    order = ordered.Order(("ord_ms", "oid"), "ord_ms")
    cuts = ordered.measure(held, ["key"], order)
    seen = ordered.scan(held, ["key"], order, {"_before": ordered.last(F.col("ord_ms"))}, cuts=cuts)
    far = F.col("_before").isNull() | ((F.col("ord_ms") - F.col("_before") > reach) & ~F.startswith("key", F.lit(BLOCK_LINK)))
    marked = ordered.scan(seen.withColumn("_start", F.when(far, F.col("ord_ms"))), ["key"], order, {"_since": ordered.last(F.col("_start"), F.col("_start").isNotNull())}, cuts=cuts)
    run = F.xxhash64("key", F.coalesce("_start", "_since"))
    return marked.select("oid", run.alias("run"), F.when(~F.startswith("key", F.lit(BLOCK_LINK)), F.col("key")).alias("key"), "ord_ms")


def _relabelled(spans: DataFrame, links: DataFrame) -> DataFrame:
    """Give spans the component that `links` (between components) lead to."""
    labels = graph.components(links, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return spans.join(labels, "component", "left").withColumn("component", F.coalesce("_to", "component")).drop("_to")


def place(obs: DataFrame, s: Settings, books: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`obs` (with a number `oid` of their own) and `books` with the `component` each belongs to.

    First runs: stretches of one key. Observations with several keys, and a block's several observations, link runs. A component
    then holds all its keys from its first observation until `reach` after its last, so components that meet on a key within their
    extents are one; this is repeated until none meet. Each key's extents are disjoint in the end, and a routine score, which
    neither opens nor extends anything, goes to the extent it falls in; where there is none it is left out.

    After a few rounds extents are widened, each time twice as far: grouping more than needed does no harm, and rounds stay
    logarithmic whatever the keys."""
    reach = s.quiet_ms + 2 * s.window_ms
    acts = (F.col("role") != "score") | F.col("pending")
    block = F.when(F.col("block_id") != "", F.array(F.concat(F.lit(BLOCK_LINK), "block_id"))).otherwise(F.array().cast("array<string>"))
    held = obs.filter(acts).select("oid", "ord_ms", F.explode(F.concat("keys", block)).alias("key"))
    if books is not None:
        held = held.unionByName(books.select((-1 - F.col("oid")).alias("oid"), F.col("last_ms").alias("ord_ms"), F.explode("keys").alias("key")))
    runs = settle(_runs(held, reach), "incident-runs")
    spans = runs.groupBy("run", "key").agg(F.min("ord_ms").alias("low"), F.max("ord_ms").alias("high")).withColumn("component", F.col("run"))
    sets = runs.groupBy("oid").agg(F.min("run").alias("a"), F.collect_set("run").alias("_runs"))
    spans = settle(_relabelled(spans, sets.select("a", F.explode("_runs").alias("b"))), "incident-spans")
    pad, order = reach, ordered.Order(("low", "component"), "low")
    for turn in range(64):
        extents = spans.groupBy("component").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        owned = spans.filter("key IS NOT NULL").select("component", "key").distinct().join(extents, "component")
        owned = settle(ordered.scan(owned, ["key"], order, {"_last": ordered.running_max(F.struct("high", "component"))}), "incident-extents")
        links = owned.filter(F.col("_last.high") + pad >= F.col("low")).select(F.col("component").alias("a"), F.col("_last.component").alias("b")).distinct()
        if not links.limit(1).count():
            break
        spans = settle(_relabelled(spans, links), "incident-spans")
        pad = reach if turn < 2 else 2 * pad
    of_run = spans.select("run", "component")
    of_act = runs.groupBy("oid").agg(F.min("run").alias("run")).join(of_run, "run").select("oid", "component")
    placed = obs.filter(acts).join(of_act, "oid")
    routine = obs.filter(~acts).withColumn("key", F.concat(F.lit("ie:"), "ie_id")).withColumn("pos", F.col("ord_ms"))
    extents = owned.select("key", F.col("low").alias("pos"), "high", "component")
    met = ordered.asof(routine, extents, ["key"], ordered.Order(("pos",), "pos"), {"component": "component", "_until": "high"}, inclusive=True)
    met = met.filter(F.col("ord_ms") <= F.col("_until") + reach).drop("key", "pos", "_until")
    kept = None if books is None else books.join(of_act.withColumn("oid", -1 - F.col("oid")), "oid")
    return placed.unionByName(met.select(*placed.columns)), kept


# -- the fold --------------------------------------------------------------------------

CHANGE = ("component bigint, n bigint, action string, incident string, block_id string, alert_id bigint, role string, level string,"
          " rule string, at_ms bigint, status string, severity string, title string, ie_id string, keys string, opened_ms bigint,"
          " last_ms bigint, closed_ms bigint, closed_by string, baseline double, low double, state string")
CHANGE_COLUMNS = [c.strip().split(" ")[0] for c in CHANGE.split(",")]


PIN, PULL = "pin", "pull"  # moves an incident's end for good; moves it at most one window past the last pin
RECOVERED, QUIET = "closed:recovered", "closed:quiet"
EVIDENCE = "alert"  # the role of an event that counts for nothing


class Fold:
    """Folds the ordered observations of one component into incidents.

    The book holds the open incidents, and the closed ones that may yet be corrected, as plain values (so that it travels as JSON
    between micro-batches), and the block placed last: its incident, and how it moves that incident's end. Each observation goes to
    the first of the handlers that takes it; what a handler changes is written to `out`, one row per change."""

    def __init__(self, s: Settings, books: list[dict] = (), stream: bool = False) -> None:
        self.s, self.stream, self.out = s, stream, []
        self.book = {"open": [], "kept": [], "changes": 0, "block": None, "home": None, "grip": None, "last": None}
        self.fresh: list[str] = []  # keys that the incident at hand gained since its last row was written
        for book in books:  # of components that have become one
            later = book["last"] and (self.book["last"] is None or book["last"] > self.book["last"])
            self.book = {**(book if later else self.book), "open": self.book["open"] + book["open"], "kept": self.book["kept"] + book["kept"],
                         "changes": max(self.book["changes"], book["changes"])}
        self.by_key: dict[str, list[dict]] = {}  # the open incidents that hold a key
        for incident in (*self.book["open"], *self.book["kept"]):
            incident["keys"] = set(incident["keys"])
        for incident in self.book["open"]:
            self.hold(incident, incident["keys"])
        self.wake = None  # nothing becomes quiet before
        self.handlers = (self.distrust, self.alert_on_placed_block, self.alert_without_home, self.score, self.join, self.open)

    # -- the two entrances --

    def feed(self, o) -> None:
        self.quiet(int(o.ord_ms))
        self.now = [int(o.ord_ms), int(o.ms_index), int(o.wf_index), o.block_id or "", int(o.rank), int(o.alert_id)]
        any(handler(o, int(o.at_ms), set(o.keys)) for handler in self.handlers)
        self.book["last"] = self.now

    def quiet(self, now_ms: int) -> None:
        """Close what saw nothing for the quiet time before `now_ms`."""
        if self.wake is not None and now_ms <= self.wake:
            return
        for incident in sorted((i for i in self.book["open"] if self.silent_at(i) < now_ms), key=lambda i: (self.silent_at(i), i["born"])):
            self.close(incident, QUIET, self.silent_at(incident))
        self.wake = min(map(self.silent_at, self.book["open"]), default=None)  # ends only move on; new incidents are told of in `open`

    # -- handlers: (observation, its time, its keys) -> whether it is done with --

    def distrust(self, o, at, keys) -> bool:
        """A block that counted lost its trust: its event becomes evidence, what it closed reopens, the recovery target is what
        the drops that remain give. Keys and the latest event are not taken back."""
        if o.role != "distrust":
            return False
        first = True
        for incident in self.holders(o.block_id):
            event = incident["events"].get(o.block_id)
            if event["role"] == EVIDENCE:
                continue
            was, event["role"] = event["role"], EVIDENCE
            reopens = incident["status"] == RECOVERED and incident["closed_by"] == o.block_id
            if reopens:
                incident |= {"status": "open", "closed": None, "closed_by": None, "reopened": int(o.ord_ms)}
                self.book["kept"].remove(incident)
                self.book["open"].append(incident)
                self.hold(incident, incident["keys"])
                self.wake = None
            if event["drop"] and event["level"] == "proven":
                left = sorted((e["at"], b) for b, e in incident["events"].items() if e["drop"] and e["level"] == "proven" and e["role"] != EVIDENCE)
                incident["low"] = min((incident["events"][b]["score"] for _, b in left), default=None)
                if left and incident["events"][left[0][1]]["base"] is not None:
                    incident["base"] = incident["events"][left[0][1]]["base"]
            self.write("revoked", incident, o, was, linked=first)
            if reopens:
                self.write("reopened", incident, o, linked=False)
            if first and self.rises(incident, o.severity):
                self.write("updated", self.raised(incident, o.severity), o)
            first = False
        return True

    def alert_on_placed_block(self, o, at, keys) -> bool:
        """An alert on a block that an incident holds belongs there; one about an attack counts like the block itself."""
        if o.alert_id < 0 or not o.block_id:
            return False
        incident, grip = self.find(self.book["home"]), self.book["grip"]
        if o.block_id != self.book["block"]:  # not right after it: held if an event says so
            incident = next(iter(self.holders(o.block_id)), None)
            if incident is None:
                return False
            event = incident["events"][o.block_id]
            grip = None if event["role"] == EVIDENCE else {"proven": PIN, "relayed": PULL}.get(event["level"])
        if incident is None or incident["status"] != "open":  # closed since
            self.write("linked", {"name": self.book["home"] if incident is None else incident["name"]}, o)
            return True
        if o.rule in (*V.ATTACK_RULES, *V.INTEGRITY_RULES):
            self.move(incident, at, grip)
        self.write("updated", self.raised(incident, o.severity), o)
        return True

    def alert_without_home(self, o, at, keys) -> bool:
        if o.link_only:
            self.write("unheld", None, o)
        return o.link_only

    def score(self, o, at, keys) -> bool:
        """A routine score opens nothing: it deepens a drop, or ends an incident whose drop it makes good."""
        if o.role != "score":
            return False
        fallen = [i for i in self.nearest(keys) if f"ie:{o.ie_id}" in i["keys"] and i["low"] is not None and at >= i["opened"]]
        for incident in fallen:
            if incident["base"] is not None and o.score >= incident["base"] - V.EPS:
                self.move(incident, at, PIN)
                self.place(incident, o, o.level, "remediation")
                self.write("attached", incident, o, "remediation")
                self.close(incident, RECOVERED, at, o)
            else:
                incident["low"] = min(incident["low"], float(o.score))
        return True

    def join(self, o, at, keys) -> bool:
        """Into the latest incident that shares a key and lies within a window of the observation."""
        near = (i for i in self.nearest(keys) if i["opened"] - self.s.window_ms <= at <= i["end"] + self.s.window_ms)
        incident = next(near, None)
        if incident is None:
            return False
        proven = o.level == "proven"
        self.move(incident, at, PIN if proven else PULL if o.level == "relayed" or o.finding else None)
        if proven:
            self.fresh = sorted(keys - incident["keys"])
            incident["keys"] |= keys
            self.hold(incident, self.fresh)
            incident["ie"] = incident["ie"] or o.ie_id
            fresh_drop = o.is_drop and incident["low"] is None
            about_it = incident["ie"] and f"ie:{incident['ie']}" in keys
            if not pd.isna(o.base) and (fresh_drop or (incident["base"] is None and about_it)):
                incident["base"] = float(o.base)
            if o.is_drop:
                incident["low"] = float(o.score) if fresh_drop else min(incident["low"], float(o.score))
        self.place(incident, o, None if o.role == "alert" else o.level, o.role)
        self.write("attached" if o.block_id else "updated", self.raised(incident, o.severity), o, o.role)
        return True

    def open(self, o, at, keys) -> bool:
        if o.opens:
            proven = o.level == "proven"
            incident = {"name": f"{o.primary}@{o.block_id or o.alert_id}", "born": self.now, "status": "open", "severity": o.severity or "low",
                        "title": o.title, "ie": o.ie_id, "keys": set(keys), "opened": at, "pinned": at, "end": at, "closed": None, "closed_by": None,
                        "base": float(o.base) if proven and o.ie_id is not None and not pd.isna(o.base) else None, "low": float(o.score) if proven and o.is_drop else None,
                        "events": {}, "reopened": None}
            self.book["open"].append(incident)
            self.fresh = sorted(keys)
            self.hold(incident, keys)
            self.wake = None if self.wake is None else min(self.wake, self.silent_at(incident))
            self.place(incident, o, o.level, "trigger")
            self.write("opened", incident, o, "trigger")
        return o.opens

    # -- the book --

    def find(self, name: str | None) -> dict | None:
        return next((i for i in self.book["open"] if i["name"] == name), None)

    def holders(self, block: str) -> list[dict]:
        """Incidents with an event of the block that may be corrected: open ones first, then the newest."""
        found = [i for i in (*self.book["open"], *self.book["kept"]) if block in i["events"]]
        return sorted(sorted(found, key=lambda i: i["born"], reverse=True), key=lambda i: i["status"] != "open")

    def nearest(self, keys: set) -> list[dict]:
        """Open incidents that share a key, the one with the latest end first."""
        found = {id(i): i for k in keys for i in self.by_key.get(k, ())}
        return sorted(found.values(), key=lambda i: (i["end"], i["born"]), reverse=True)

    def hold(self, incident: dict, keys) -> None:
        for k in keys:
            self.by_key.setdefault(k, []).append(incident)

    def silent_at(self, incident: dict) -> int:
        return max(incident["end"] + self.s.quiet_ms, incident["reopened"] or 0)

    def move(self, incident: dict, at: int, grip: str | None) -> None:
        if grip == PIN:
            incident["pinned"] = max(incident["pinned"], at)
        if grip:
            incident["end"] = max(incident["end"], at if grip == PIN else min(at, incident["pinned"] + self.s.window_ms))

    def rises(self, incident: dict, severity: str | None) -> bool:
        return V.SEVERITY_RANK.get(severity or "", -1) > V.SEVERITY_RANK.get(incident["severity"], -1)

    def raised(self, incident: dict, severity: str | None) -> dict:
        if self.rises(incident, severity):
            incident["severity"] = severity
        return incident

    def place(self, incident: dict, o, level: str | None, role: str) -> None:
        """The block is an event of the incident. What a later correction may need of it is kept."""
        if o.block_id:
            self.book |= {"block": o.block_id, "home": incident["name"], "grip": {"proven": PIN, "relayed": PULL}.get(level)}
            if self.stream or o.pending or o.is_drop:
                incident["events"][o.block_id] = {"role": role, "level": level, "at": int(o.at_ms), "drop": bool(o.is_drop), "pending": self.stream or bool(o.pending),
                                                  "score": None if pd.isna(o.score) else float(o.score), "base": None if pd.isna(o.base) else float(o.base)}

    def close(self, incident: dict, status: str, at: int, o=None) -> None:
        incident |= {"status": status, "closed": int(at), "closed_by": o.block_id if o else None}
        self.write("closed", incident, o)
        self.book["open"].remove(incident)
        for k in incident["keys"]:
            left = [i for i in self.by_key.pop(k) if i is not incident]
            if left:
                self.by_key[k] = left
        if any(e["pending"] for e in incident["events"].values()):
            self.book["kept"].append(incident)

    def write(self, action: str, incident: dict | None, o=None, role: str | None = None, state: str | None = None, linked: bool = True) -> None:
        self.book["changes"] += 1
        seen = (None,) * 2 if o is None else (o.block_id or None, int(o.alert_id) if linked and o.alert_id >= 0 else None)
        known = (None,) * 3 if o is None else (o.level, o.rule, int(o.at_ms))
        i = incident or {}
        # an incident may gather the keys of the whole ledger: a row tells those that it adds, `incidents` adds them up
        gained, self.fresh = json.dumps(self.fresh) if self.fresh else None, []
        as_it_is = [i.get(k) for k in ("status", "severity", "title", "ie")] + [gained] + [
            i.get(k) for k in ("opened", "end", "closed", "closed_by", "base", "low")]
        self.out.append((self.book["changes"], action, i.get("name"), *seen, role, *known, *as_it_is, state))

    def put_down(self, as_of_ms: int) -> None:
        """End of the observations: what stands, or in a stream the book for those to come."""
        self.quiet(as_of_ms)
        if not self.stream:
            for incident in self.book["open"]:
                self.write("standing", incident)
            return
        self.book["kept"] = [i for i in self.book["kept"] if i["closed"] + self.s.keep_ms >= as_of_ms]
        recent = self.book["last"] and self.book["last"][0] + self.s.quiet_ms >= as_of_ms  # alerts on the last block may still come
        if self.book["open"] or self.book["kept"] or recent:
            self.write("state", None, state=json.dumps(self.book, default=sorted))  # sets of keys as lists


def _book_row(state: str) -> tuple[list[str], int, str]:
    """The keys by which later observations meet a book, and the last time at which they can."""
    book = json.loads(state)
    held = [*book["open"], *book["kept"]]
    keys = {k for i in book["open"] for k in i["keys"]} | {BLOCK_LINK + b for i in held for b, e in i["events"].items() if e["pending"]}
    keys |= {BLOCK_LINK + book["block"]} if book["block"] else set()
    return sorted(keys), max([book["last"][0], *(i["end"] for i in book["open"]), *(i["reopened"] or 0 for i in book["open"])]), state


def fold_rows(batches: Iterator[pd.DataFrame], s: Settings, as_of_ms: int, stream: bool) -> Iterator[pd.DataFrame]:
    """Fold sorted observations of many components, batch by batch: memory holds the book of one.

    Rows with a `state` come first in their component: the books it goes on from."""
    key, books, fold = None, [], None

    def started() -> Fold:
        return fold or Fold(s, books, stream)

    def table(rows: list[tuple]) -> pd.DataFrame:
        got = pd.DataFrame(rows, columns=CHANGE_COLUMNS)
        for c in ("alert_id", "at_ms", "opened_ms", "last_ms", "closed_ms"):
            got[c] = got[c].astype("Int64")
        return got

    for pdf in batches:
        rows: list[tuple] = []
        for o in pdf.itertuples(index=False):
            if o.component != key:
                if key is not None:
                    fold = started()
                    fold.put_down(as_of_ms)
                    rows += [(key, *row) for row in fold.out]
                key, books, fold = o.component, [], None
            if isinstance(o.state, str):
                books.append(json.loads(o.state))
                continue
            fold = started()
            fold.feed(o)
            if len(fold.out) > 1000:
                rows += [(key, *row) for row in fold.out]
                fold.out = []
        if rows:
            yield table(rows)
    if key is not None:
        fold = started()
        fold.put_down(as_of_ms)
        yield table([(key, *row) for row in fold.out])


def advance(obs: DataFrame, s: Settings, as_of_ms: int, books: DataFrame | None = None, stream: bool = False) -> DataFrame:
    """The changes that observations (with a number `oid` of their own) make, going on from the books of earlier ones.

    books: keys, last_ms, state, oid. In a stream the rows with action "state" are the books to go on from."""
    placed, kept = place(obs, s, books)
    rows = placed.select("component", *COLUMNS, F.lit(None).cast("string").alias("state"))
    if kept is not None:
        no = {c: F.lit(0).cast("bigint") for c in ("ord_ms", "ms_index", "wf_index", "alert_id", "at_ms")}  # nulls would make the batch's numbers floats
        rows = rows.unionByName(kept.select("component", "state").withColumns({**no, "rank": F.lit(0)}), allowMissingColumns=True)
    sorted_ = rows.repartition("component").sortWithinPartitions("component", F.col("state").isNull(), *ORDER)
    return settle(sorted_.mapInPandas(lambda batches: fold_rows(batches, s, as_of_ms, stream), CHANGE), "changes")


def books_of(changes: DataFrame) -> DataFrame:
    """The books that the changes end with, ready to go on from."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_book_row(state) for state in pdf["state"]], columns=["keys", "last_ms", "state"])

    return changes.filter("action = 'state'").select("state").mapInPandas(rows, BOOK)


def numbered(obs: DataFrame, name: str) -> DataFrame:
    """Observations written down, each with a number of its own."""
    return settle(obs.withColumn("block_id", F.coalesce("block_id", F.lit(""))).withColumn("oid", F.monotonically_increasing_id()), name)


def of_the_ledger(obs: DataFrame, changes: DataFrame) -> DataFrame:
    """Observations of the ledger as such: those that are, and alerts whose block no incident holds."""
    loose = changes.filter("action = 'unheld'").select("alert_id")
    homeless = obs.filter("link_only").join(loose, "alert_id", "left_semi").withColumns({"keys": F.array(F.lit(LEDGER)), "link_only": F.lit(False), "ie_id": F.lit(None).cast("string")})
    return _complete(homeless).unionByName(_complete(obs.filter(F.col("primary") == LEDGER)))


def observe(messages: DataFrame, alerts: DataFrame, submissions: DataFrame, policy: DataFrame, context: DataFrame, hosts: DataFrame, s: Settings) -> DataFrame:
    """All observations, numbered: messages, alerts right after their blocks, late distrust at its own time."""
    subjects = settle(_subjects(messages, policy, alerts, submissions, hosts, s), "subjects")
    known = context.select("ie_id").union(hosts.select("host_ie")).distinct()
    counted = settle(message_observations(subjects, s), "message-observations")
    raised = alerts_on_blocks(alerts, subjects, s)
    late = distrust_observations(raised.filter("late"), counted)
    return numbered(counted.unionByName(alert_observations(raised, known)).unionByName(late), "observations")


def correlate(messages: DataFrame, alerts: DataFrame, submissions: DataFrame, policy: DataFrame, context: DataFrame,
              hosts: DataFrame, as_of_ms: int, s: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations, changes). The change feed is written to the shared folder, as later tables derive from it."""
    s = s or Settings()
    obs = observe(messages, alerts, submissions, policy, context, hosts, s)
    return obs, fold_all(obs, s, as_of_ms)


def fold_all(obs: DataFrame, s: Settings, as_of_ms: int) -> DataFrame:
    """The changes of all observations at once: first those of elements, components and issuers, then those of the ledger as such."""
    changes = advance(obs.filter(F.col("primary") != LEDGER), s, as_of_ms)
    more = advance(numbered(of_the_ledger(obs, changes), "ledger-observations"), s, as_of_ms)
    return changes.filter("action <> 'unheld'").unionByName(more)


def memberships(changes: DataFrame) -> DataFrame:
    """The log of who is an event of what: a row with sign 1 when a block joins an incident, and when its trust is taken back one
    with sign -1 for what it was and one with sign 1 as evidence. What is left after adding up is how things stand."""
    block = changes.filter(F.col("action").isin("opened", "attached", "revoked") & F.col("block_id").isNotNull())
    revoked = F.col("action") == "revoked"
    row = lambda sign, role, when: F.when(when, F.struct(F.lit(sign).alias("sign"), role.alias("role")))
    rows = F.array_compact(F.array(row(1, F.col("role"), ~revoked), row(-1, F.col("role"), revoked), row(1, F.lit(EVIDENCE), revoked)))
    return block.select("incident", "block_id", "n", "at_ms", "level", "rule", F.explode(rows).alias("_r")).select(
        "incident", "block_id", "n", "_r.sign", "_r.role", "at_ms", F.col("level").alias("trust"), "rule")


def _json_list(texts: Column) -> Column:
    """A JSON list, spaced as Python writes it."""
    quoted = F.transform(texts, lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def incidents(changes: DataFrame) -> DataFrame:
    """The incidents as they stand: the last row of each, with all the keys it gained and how many events and alerts joined."""
    rows = changes.filter("incident IS NOT NULL")
    final = F.struct("title", "status", "severity", "ie_id", "opened_ms", "last_ms", "closed_ms", "closed_by", "baseline", "low")
    return (rows.groupBy("incident").agg(
        F.max_by(final, F.when(F.col("status").isNotNull(), F.col("n"))).alias("f"),
        F.count_if(F.col("action").isin("opened", "attached") & F.col("block_id").isNotNull()).alias("events"),
        F.flatten(F.collect_list(F.from_json("keys", "array<string>"))).alias("_keys"),
        F.count("alert_id").alias("alerts")).select(
            "incident", "f.title", "f.status", "f.severity", "f.ie_id", _json_list(F.array_sort("_keys")).alias("keys"), "f.opened_ms", "f.last_ms", "f.closed_ms",
            "f.closed_by", "f.baseline", "f.low", "events", "alerts"))


def events(changes: DataFrame) -> DataFrame:
    """The blocks of each incident with their role and trust as they stand: the sums of the membership log."""
    one = memberships(changes).groupBy("incident", "block_id", "role").agg(
        F.sum("sign").alias("sign"), F.min_by(F.struct("at_ms", "trust", "rule"), "n").alias("e"))
    return one.filter("sign > 0").select("incident", "block_id", "role", "e.at_ms", "e.trust", "e.rule")


def linked_alerts(changes: DataFrame) -> DataFrame:
    return changes.filter("incident IS NOT NULL AND alert_id IS NOT NULL").select("incident", "alert_id", "action").distinct()


def timeline(events_: DataFrame, messages: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Incident events with what is known of their blocks: verdict, latest status, time to sort by."""
    m = messages.select("block_id", "tag", "verdict", "received_at_ms", "confirmed_at_ms", "ms_index", "ts")
    status = lifecycle.filter("block_id IS NOT NULL").groupBy("block_id").agg(F.max_by("status", F.struct("at_ms", "id")).alias("_status"))
    df = events_.join(m, "block_id", "left").join(status, "block_id", "left")
    return df.select("incident", "block_id", "role", "tag", "verdict",
                     F.coalesce("_status", F.when(F.col("ms_index").isNotNull(), "CONFIRMED")).alias("status"),
                     F.coalesce("at_ms", "received_at_ms", "confirmed_at_ms", F.col("ts") * 1000).alias("sort_ms"))


def recovery_targets(events_: DataFrame, observations: DataFrame) -> DataFrame:
    """Per incident the level its first proven drop fell from, and the lowest proven drop."""
    drops = observations.filter("is_drop AND level = 'proven'").select("block_id", "score", "base")
    df = events_.filter(f"trust = 'proven' AND role <> '{EVIDENCE}'").select("incident", "block_id", "at_ms").join(drops, "block_id")
    return df.groupBy("incident").agg(F.min_by("base", F.struct("at_ms", "block_id")).alias("target"), F.min("score").alias("lowest"))


def sessions(rows: DataFrame, gap_s: int) -> DataFrame:
    """Plain sessions: events of an element at most `gap_s` apart (the gap itself still joins).

    An ordered scan finds where sessions start; counting them is an ordinary aggregate, combined before
    the shuffle, so a busy element is no single task's work."""
    seen = ordered.scan(rows, ["ie_id"], ordered.BY_TIME, {"_before": ordered.last(F.col("ts"))})
    far = F.col("_before").isNull() | (F.col("ts") - F.col("_before") > gap_s)
    seen = seen.withColumn("_start", F.when(far, F.col("ts")))
    runs = ordered.scan(seen, ["ie_id"], ordered.BY_TIME, {"_since": ordered.last(F.col("_start"), F.col("_start").isNotNull())})
    return (runs.groupBy("ie_id", F.coalesce("_start", "_since").alias("opened"))
            .agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("events")))
