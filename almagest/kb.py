"""A knowledge base as an append-only log of revisions, with tables derived from it, written and queried by dicts.

Every write is one revision: a JSON line in ``log/``, under a number that is claimed by making a file, so that writers
in several processes never take the same one. A table is its Parquet folders, listed by the newest pointer file in
``base/<table>``, together with the rows of later revisions; ``compact`` moves the log's rows into a new folder and then
makes a new pointer, so that a crash leaves the table as it was. Every read operation builds a DataFrame first;
``query`` renders it. The root may lie on any file system that driver and executors share.
"""

from __future__ import annotations

import base64
import hashlib
import json
import secrets
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.functions import allen, fuzzy, text, vectors
from almagest.functions.ids import canonical_id
from almagest.functions.temporal_text import parse
from almagest.operators import claims, graph, search, series
from almagest.plans import cut, small
from almagest.sources.files import Files

_OBJECT = "struct<kind:string,resource:string,text:string,lang:string,amount:double,unit:string,moment:string>"
_PLACE = "struct<frame:string,minx:double,miny:double,maxx:double,maxy:double,z:double>"
TABLES = {
    "resources": "resource_id string, types array<string>, label string, lang string, aliases array<string>, description string, external_ids array<string>, visibility string, license string",
    "assertions": f"claim_id string, subject string, predicate string, object {_OBJECT}, negated boolean, valid_time string, calendar string, branch_id string, canon string, timeline string, source_reliability double, extraction_conf double, visibility string, license string, first_known_at bigint, note string, supersedes string, created_at bigint, es bigint, ls bigint, ee bigint, le bigint, axis string",
    "status_changes": "claim_id string, status string, basis_at bigint, reason string, verified boolean, superseded_by string",
    "evidence": "claim_id string, acquisition string, extractor string, model string, model_version string, extracted_at bigint",
    "merge_proposals": "merge_id string, from_id string, into_id string, reason string, requested_at bigint", "merge_decisions": "merge_id string, approved boolean",
    "sources": "source_id string, source string, locator string, kind string, title string, origin string, provenance_root string, reliability double, license string, visibility string, owner string", "acquisitions": "acquisition string, source_id string, acquired_at bigint, acquired_by string, hash string, media_type string",
    "snapshots": "hash string, body string, key_id string", "events": "owner string, conversation string, event_id string, sequence bigint, kind string, origin string, received_at bigint, call_id string, supersedes string, content string, hash string, key_id string",
    "observations": "obs_id string, target string, metric string, observed_at bigint, recorded_at bigint, value double, unit string, acquisition string, branch_id string", "samples": "target string, trajectory string, frame string, how string, t bigint, x double, y double, z double",
    "predicates": "key string, functional boolean, role string, status string", "types": "type_key string, label string, parents array<string>, status string", "calendars": "key string, axis string, kind string, body string", "frames": "key string, parent string, matrix array<double>", "licenses": "key string, redistributable boolean",
    "rank_policies": "key string, body string", "branches": "branch_id string, branch_name string, parent string, fork_seq bigint", "sequences": "sequence string, scope string, kind string, items array<string>", "datasets": "dataset string, pk array<string>, columns array<string>", "dataset_rows": "dataset string, row_key string, body string", "row_links": "dataset string, row_key string, resource string",
    "embeddings": "resource_id string, space string, embedding array<float>", "placements": f"resource_id string, placement {_PLACE}",
}
_LOG = "seq bigint, op string, at bigint, actor string, rows array<struct<t:string,row:string>>"
MAIN = "main"
RECENT, RECENT_CHARS = 2_000, 1_000_000  # revisions since the last compaction that the driver reads itself, at most
# Built-in types, each with the one above it.
BUILTIN_TYPES = {
    child: parent
    for parent, children in {
        None: "Resource", "Resource": "Event Entity Place Work Document Dataset Concept", "Entity": "Person Character Organization Object", "Object": "Vehicle", "Place": "World Region Area Subplace Building Station TransportFacility VirtualSpace Dream", "Region": "Country City", "Subplace": "Room",
        "Area": "Dungeon", "World": "Dimension", "Work": "Franchise Series Season Episode Movie OVA Volume Chapter Game Book", "Document": "WebPage Post Image Video Audio", "Dataset": "Table", "Concept": "Predicate Type Canon Timeline",
    }.items()
    for child in children.split()
}


class KbError(Exception):
    """code is one of: invalid, not_found, conflict, forbidden, incomparable, withheld, ambiguous, budget, internal."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def new_id(prefix: str) -> str:
    """Ordered by time: 48 bits of milliseconds, then random bits."""
    return f"{prefix}_{int(time.time() * 1000):012x}7{secrets.token_hex(10)[:19]}"


def _need(req: dict, *names: str) -> list:
    missing = [n for n in names if req.get(n) is None]
    if missing:
        raise KbError("invalid", f"missing {', '.join(missing)}")
    return [req[n] for n in names]


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = lambda: int(time.time() * 1000)) -> None:
        self.spark, self.clock = spark, clock
        self.files = Files(spark, root)
        self.lock = threading.Lock()
        self.warnings: list[str] = []
        self.read: dict[str, dict] = {}

    @property
    def seq(self) -> int:
        """The last revision, whoever wrote it."""
        done = [int(n[:-5]) for n in self.files.names("log") if n.endswith(".json")]
        return max([*done, self._pointer("_revisions")["seq"]], default=0)

    # -- tables

    def log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).json(self.files.at("log/*.json")) if any(n.endswith(".json") for n in self.files.names("log")) else self.spark.createDataFrame([], _LOG)

    def _pointer(self, name: str) -> dict:
        """The folders of a table and the last revision they hold."""
        known = sorted(n for n in self.files.names(f"base/{name}") if n.startswith("at-"))
        return json.loads(self.files.read(f"base/{name}/{known[-1]}")) if known else {"dirs": [], "seq": 0, "n": 0}

    def _point(self, name: str, old: dict, folder: str, seq: int) -> None:
        self.files.put(f"base/{name}/at-{old['n'] + 1:012d}", json.dumps({"dirs": [*old["dirs"], folder], "seq": seq, "n": old["n"] + 1}).encode())

    def _base(self, name: str, p: dict) -> DataFrame | None:
        return self.spark.read.schema(f"seq bigint, {TABLES[name]}").parquet(*[self.files.at(f"base/{name}/{d}") for d in p["dirs"]]) if p["dirs"] else None

    def _recent(self, after: int, until: int | None) -> list[dict] | None:
        """The revisions after one, read by the driver, if they are few and small; else None. Files never change, so each is read once."""
        names = [n for n in self.files.names("log") if n.endswith(".json") and after < int(n[:-5]) and (until is None or int(n[:-5]) <= until)]
        if len(names) > RECENT:
            return None
        for n in names:
            if n not in self.read:
                self.read[n] = json.loads(self.files.read(f"log/{n}"))
        found = [self.read[n] for n in sorted(names)]
        return found if sum(len(r["row"]) for x in found for r in x["rows"]) <= RECENT_CHARS else None

    def _tail(self, name: str, after: int, until: int | None = None) -> DataFrame:
        schema = T.StructType([T.StructField("seq", T.LongType()), *T.StructType.fromDDL(TABLES[name]).fields])
        few = self._recent(after, until)
        if few is not None:  # a literal, so that plans know how small it is
            rows = [f'{{"seq": {x["seq"]}, {r["row"].strip()[1:]}' for x in few for r in x["rows"] if r["t"] == name]
            return self.spark.range(1).select(F.explode(F.from_json(F.lit(f"[{', '.join(rows)}]"), T.ArrayType(schema))).alias("x")).select("x.*")
        log = self.log().filter(F.col("seq") > after)
        rows = (log if until is None else log.filter(F.col("seq") <= until)).select("seq", F.explode("rows").alias("r")).filter(F.col("r.t") == name)
        return rows.select("seq", F.from_json("r.row", TABLES[name]).alias("x")).select("seq", "x.*")

    def table(self, name: str) -> DataFrame:
        """The table with seq, the revision of each row; bulk rows have that of their load."""
        p = self._pointer(name)
        base, tail = self._base(name, p), self._tail(name, p["seq"])
        return tail if base is None else base.unionByName(tail)

    def bulk_load(self, name: str, df: DataFrame) -> None:
        """Append many rows of a table as Parquet; missing columns are null, others are ignored."""
        p, schema, have = self._pointer(name), self.spark.createDataFrame([], TABLES[name]).schema, set(df.columns)
        cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        folder = f"rows-{uuid.uuid4().hex}"
        df.select(F.lit(self.seq).cast("bigint").alias("seq"), *cols).write.parquet(self.files.at(f"base/{name}/{folder}"))
        self._point(name, p, folder, p["seq"])

    def compact(self, name: str) -> None:
        """The log's rows of the table as Parquet; they count from the moment the new pointer is there."""
        p, until, folder = self._pointer(name), self.seq, f"rows-{uuid.uuid4().hex}"
        self._tail(name, p["seq"], until).write.parquet(self.files.at(f"base/{name}/{folder}"))
        self._point(name, p, folder, until)

    def trim(self) -> int:
        """Compact all tables, keep the headers of the revisions, and remove the log files they cover; returns how many."""
        until = self.seq
        for name in TABLES:
            self.compact(name)
        p, folder = self._pointer("_revisions"), f"rows-{uuid.uuid4().hex}"
        self._headers(self.log().filter((F.col("seq") > p["seq"]) & (F.col("seq") <= until))).write.parquet(self.files.at(f"base/_revisions/{folder}"))
        self._point("_revisions", p, folder, until)
        old = [n for n in self.files.names("log") if n[:12].isdigit() and int(n[:12]) <= until]
        for n in old:
            self.read.pop(n, None)
            self.files.remove(f"log/{n}")
        return len(old)

    @staticmethod
    def _headers(log: DataFrame) -> DataFrame:
        return log.select("seq", "op", "at", "actor", F.size("rows").alias("rows"))

    def revisions(self) -> DataFrame:
        p = self._pointer("_revisions")
        new = self._headers(self.log().filter(F.col("seq") > p["seq"]))
        return new.unionByName(self.spark.read.parquet(*[self.files.at(f"base/_revisions/{d}") for d in p["dirs"]])) if p["dirs"] else new

    # -- writes

    def write(self, req: dict, actor: str = "anonymous") -> dict:
        """One atomic revision; returns its seq and what was made."""
        f = getattr(self, f"_w_{req.get('op')}", None)
        if f is None:
            raise KbError("invalid", f"unknown operation {req.get('op')!r}")
        with self.lock:
            while True:
                seq = self.seq + 1
                rows, out = f(req)
                if not rows:
                    return {"seq": seq - 1, **out}
                if self.files.claim(f"log/{seq:012d}.claim"):
                    break
                # another process took the number: what was checked may no longer hold
                while not self.files.exists(f"log/{seq:012d}.json"):
                    taken = self.files.fs.getFileStatus(self.files._path(f"log/{seq:012d}.claim")).getModificationTime()
                    if time.time() * 1000 - taken > 60_000:  # its writer is gone: the number stays empty
                        self.files.put(f"log/{seq:012d}.json", json.dumps({"seq": seq, "op": "none", "at": self.clock(), "actor": "", "rows": []}).encode())
                    time.sleep(0.05)
            line = json.dumps({"seq": seq, "op": req["op"], "at": self.clock(), "actor": actor, "rows": [{"t": t, "row": json.dumps(r, ensure_ascii=False)} for t, r in rows]}, ensure_ascii=False)
            self.files.put(f"log/{seq:012d}.json", (line + "\n").encode())
            return {"seq": seq, **out}

    def _exists(self, table: str, col: str, value: str) -> bool:
        return not self.table(table).filter(F.col(col) == value).isEmpty()

    def _w_create_resource(self, q: dict):  # noqa: ANN202
        (label,) = _need(q, "label")
        ext = q.get("external_ids") or []
        if ext and not self.table("resources").filter(F.arrays_overlap("external_ids", F.array(*[F.lit(x) for x in ext]))).isEmpty():
            raise KbError("conflict", "external id is taken")
        rid = q.get("id") or new_id("res")
        row = {"resource_id": rid, "label": label, **{k: q.get(k) for k in ("types", "lang", "aliases", "description", "external_ids", "visibility", "license")}}
        rows = [("resources", row)]
        if q.get("placement"):
            rows.append(("placements", {"resource_id": rid, "placement": q["placement"]}))
        return rows, {"id": rid}

    def _w_update_resource(self, q: dict):  # noqa: ANN202
        (rid,) = _need(q, "id")
        old = self.table("resources").filter(F.col("resource_id") == rid).orderBy(F.desc("seq")).first()
        if old is None:
            raise KbError("not_found", rid)
        row = old.asDict(recursive=True)
        row.pop("seq")
        for k in ("aliases", "external_ids", "types"):
            row[k] = list(dict.fromkeys([*(row[k] or []), *(q.get(k) or [])]))
        row["description"] = q.get("description", row["description"])
        return [("resources", row)], {"id": rid}

    def _w_propose_assertion(self, q: dict):  # noqa: ANN202
        subject, predicate, obj = _need(q, "subject", "predicate", "object")
        if not self._exists("resources", "resource_id", subject):
            raise KbError("not_found", subject)
        if predicate in ("same_as", "possibly_same_as", "distinct_from") and obj.get("resource") == subject:
            raise KbError("invalid", "a resource is not compared with itself")
        kind = next((k for k in ("resource", "time", "quantity", "text") if k in obj), "unknown")
        o = {"kind": kind, "resource": obj.get("resource"), "text": obj.get("text"), "lang": obj.get("lang"), "amount": obj.get("quantity"), "unit": obj.get("unit"), "moment": obj.get("time")}
        now, when = self.clock(), parse(obj.get("time") or q.get("valid_time"), self.clock(), q.get("offset_min", 0))
        r, cid = when.range, q.get("id") or new_id("asr")
        row = {"claim_id": cid, "subject": subject, "predicate": predicate, "object": o, "negated": bool(q.get("negated")), "branch_id": q.get("branch", MAIN), "first_known_at": q.get("acquired_at", now), "created_at": now, "axis": q.get("calendar") or "gregorian",
               **({"es": r.es, "ls": r.ls, "ee": r.ee, "le": r.le} if r else {}), **{k: q.get(k) for k in ("valid_time", "calendar", "canon", "timeline", "source_reliability", "extraction_conf", "visibility", "license", "note", "supersedes")}}
        ev = [("evidence", {"claim_id": cid, **e}) for e in q.get("evidence") or []]
        return [("assertions", row), ("status_changes", {"claim_id": cid, "status": q.get("status", "accepted"), "basis_at": row["first_known_at"]}), *ev], {"id": cid, "resolved": r is not None}

    def _status(self, q: dict, status: str | None, **more):  # noqa: ANN003, ANN202
        (cid,) = _need(q, "id")
        if not self._exists("assertions", "claim_id", cid):
            raise KbError("not_found", cid)
        return [("status_changes", {"claim_id": cid, "status": status, "basis_at": q.get("basis_at", self.clock()), "reason": q.get("reason"), **more})], {"id": cid}

    def _w_retract(self, q: dict):  # noqa: ANN202
        return self._status(q, "retracted")

    def _w_dispute(self, q: dict):  # noqa: ANN202
        return self._status(q, "disputed")

    def _w_accept(self, q: dict):  # noqa: ANN202
        """Also supersedes the claim that this one was proposed to replace."""
        rows, out = self._status(q, "accepted")
        old = self.table("assertions").filter(F.col("claim_id") == q["id"]).first()["supersedes"]
        return [*rows, *([("status_changes", {**rows[0][1], "claim_id": old, "status": "superseded", "superseded_by": q["id"]})] if old else [])], out

    def _w_verify(self, q: dict):  # noqa: ANN202
        return self._status(q, None, verified=True)

    def _w_supersede(self, q: dict):  # noqa: ANN202
        rows, _ = self._status(q, "superseded")
        (new,) = _need(q, "by")
        old = self.table("assertions").filter(F.col("claim_id") == q["id"]).first()
        if (new.get("subject", old["subject"]), new.get("predicate", old["predicate"])) != (old["subject"], old["predicate"]):
            raise KbError("invalid", "a claim is superseded by one of the same subject and predicate")
        made, out = self._w_propose_assertion({**new, "subject": old["subject"], "predicate": old["predicate"], "supersedes": q["id"]})
        rows[0][1]["superseded_by"] = out["id"]
        return [*made, *rows], out

    def _w_add_evidence(self, q: dict):  # noqa: ANN202
        cid, ev = _need(q, "id", "evidence")
        return [("evidence", {"claim_id": cid, **e}) for e in ev], {"id": cid}

    def _w_merge_identity(self, q: dict):  # noqa: ANN202
        a, b = _need(q, "from", "into")
        blocked = self.claims().filter((F.col("predicate") == "distinct_from") & ~F.col("negated") & (((F.col("subject") == a) & (F.col("object.resource") == b)) | ((F.col("subject") == b) & (F.col("object.resource") == a))))
        if not blocked.isEmpty():
            raise KbError("conflict", "a live claim says they are distinct")
        mid = new_id("mrg")
        return [("merge_proposals", {"merge_id": mid, "from_id": a, "into_id": b, "reason": q.get("reason"), "requested_at": self.clock()})], {"id": mid}

    def _w_decide_merge(self, q: dict):  # noqa: ANN202
        mid, ok = _need(q, "id", "approve")
        if not self._exists("merge_proposals", "merge_id", mid):
            raise KbError("not_found", mid)
        return [("merge_decisions", {"merge_id": mid, "approved": bool(ok)})], {"id": mid}

    def _body(self, q: dict) -> tuple[bytes | None, str | None]:
        raw = base64.b64decode(q["content_base64"]) if q.get("content_base64") else q["content"].encode() if q.get("content") is not None else None
        return raw, None if raw is None else "sha256:" + hashlib.sha256(raw).hexdigest()

    def _sealed(self, raw: bytes, key_id: str | None) -> str:
        if key_id is None:
            return base64.b64encode(raw).decode()
        key = self._key(key_id)
        if key is None:
            raise KbError("not_found", key_id)
        return self.spark.range(1).select(F.base64(F.aes_encrypt(F.lit(bytearray(raw)), F.lit(bytearray(key)), F.lit("GCM")))).first()[0]

    def _opened(self, body: str, key_id: str | None) -> bytes | None:
        """None if the key has been shredded."""
        if key_id is None:
            return base64.b64decode(body)
        key = self._key(key_id)
        return None if key is None else bytes(self.spark.range(1).select(F.aes_decrypt(F.unbase64(F.lit(body)), F.lit(bytearray(key)), F.lit("GCM"))).first()[0])

    def _key(self, key_id: str) -> bytes | None:
        return self.files.read(f"vault/{key_id}")

    def _w_create_key(self, q: dict):  # noqa: ANN202
        kid = q.get("id") or new_id("key")
        self.files.put(f"vault/{kid}", secrets.token_bytes(32))  # never in the log
        return [], {"id": kid}

    def _w_shred_key(self, q: dict):  # noqa: ANN202
        (kid,) = _need(q, "id")
        self.files.remove(f"vault/{kid}")
        return [], {"id": kid}

    def _w_link_source(self, q: dict):  # noqa: ANN202
        owner = q.get("owner") if q.get("visibility") == "private" else None
        locator = (f"{owner}\0" if owner else "") + (q.get("url") or json.dumps(q.get("locator"), sort_keys=True))
        rows = []
        old = self.table("sources").filter(F.col("locator") == locator).first()
        sid = old["source_id"] if old else new_id("src")
        if not old:
            rows.append(("sources", {"source_id": sid, "source": q.get("title"), "locator": locator, "owner": owner, **{k: q.get(k) for k in ("kind", "title", "origin", "provenance_root", "reliability", "license", "visibility")}}))
        raw, digest = self._body(q.get("acquisition") or {})
        aq = new_id("acq")
        a = q.get("acquisition") or {}
        rows.append(("acquisitions", {"acquisition": aq, "source_id": sid, "acquired_at": a.get("acquired_at", self.clock()), "acquired_by": a.get("acquired_by"), "hash": digest, "media_type": a.get("media_type")}))
        if raw is not None and not self._exists("snapshots", "hash", digest):
            rows.append(("snapshots", {"hash": digest, "body": self._sealed(raw, a.get("encrypt_with")), "key_id": a.get("encrypt_with")}))
        return rows, {"source": sid, "acquisition": aq, "hash": digest}

    def _w_record_event(self, q: dict):  # noqa: ANN202
        return self._w_record_events({"events": [q]})

    def _w_record_events(self, q: dict):  # noqa: ANN202
        (events,) = _need(q, "events")
        if not 1 <= len(events) <= 1000:
            raise KbError("invalid", "1 to 1000 events")
        known = self.table("events")
        rows, done, seen = [], [], {}
        wanted = [F.lit(e["event_id"]) for e in events]
        old = {(r.owner, r.event_id): r.hash for r in known.filter(F.col("event_id").isin([e["event_id"] for e in events])).select("owner", "event_id", "hash").collect()} if wanted else {}
        asked = self.spark.createDataFrame([(e.get("owner"), e.get("conversation"), e.get("sequence")) for e in events], "owner string, conversation string, sequence bigint").distinct()
        taken = {(r.owner, r.conversation, r.sequence): r.event_id for r in known.join(F.broadcast(asked), ["owner", "conversation", "sequence"]).select("owner", "conversation", "sequence", "event_id").collect()}  # at most one a place asked for
        for e in events:
            owner, conv, eid = _need(e, "owner", "conversation", "event_id")
            raw, digest = self._body(e)
            have = old.get((owner, eid), seen.get((owner, eid)))
            if have is not None:
                if have != digest:
                    raise KbError("conflict", f"{eid} exists with other content")
                done.append("duplicate")
                continue
            place = (owner, conv, e.get("sequence"))
            if e.get("sequence") is not None and taken.get(place, eid) != eid:
                raise KbError("conflict", f"sequence {e['sequence']} is taken")
            taken[place], seen[owner, eid] = eid, digest
            rows.append(("events", {"owner": owner, "conversation": conv, "event_id": eid, "content": self._sealed(raw or b"", e.get("encrypt_with")), "hash": digest, "key_id": e.get("encrypt_with"), "received_at": e.get("received_at", self.clock()), **{k: e.get(k) for k in ("sequence", "kind", "origin", "call_id", "supersedes")}}))
            done.append("recorded")
        return rows, {"events": done}

    def _plain(table: str, prefix: str | None, id_field: str, *fields: str, need: tuple[str, ...] = ()):  # noqa: ANN202, N805
        """An operation that appends one row as given."""

        def f(self: KnowledgeBase, q: dict):  # noqa: ANN202
            _need(q, *need)
            made = q.get("id") or q.get(id_field) or (new_id(prefix) if prefix else None)
            return [(table, {id_field: made, **{k: q.get(k) for k in fields}})], {"id": made}

        return f

    _w_add_observation = _plain("observations", "obs", "obs_id", "target", "metric", "observed_at", "recorded_at", "value", "unit", "acquisition", "branch_id", need=("target", "metric", "observed_at"))
    _w_propose_predicate = _plain("predicates", None, "key", "functional", "role", "status", need=("key",))
    def _w_accept_predicate(self, q: dict):  # noqa: ANN202
        (key,) = _need(q, "key")
        if not self._exists("predicates", "key", key):
            raise KbError("not_found", key)
        return [("predicates", {"key": key, "status": "accepted", **{k: q[k] for k in ("functional", "role") if q.get(k) is not None}})], {"id": key}

    _w_propose_type = _plain("types", None, "type_key", "label", "parents", "status", need=("type_key",))
    _w_define_calendar = _plain("calendars", None, "key", "axis", "kind", "body", need=("key", "axis"))
    _w_define_frame = _plain("frames", None, "key", "parent", "matrix", need=("key",))
    _w_define_license = _plain("licenses", None, "key", "redistributable", need=("key",))
    _w_set_rank_policy = _plain("rank_policies", None, "key", "body", need=("key",))
    _w_define_sequence = _plain("sequences", "seq", "sequence", "scope", "kind", "items", need=("scope", "items"))
    _w_define_table = _plain("datasets", "tbl", "dataset", "pk", "columns", need=("pk", "columns"))
    _w_link_row = _plain("row_links", None, "dataset", "row_key", "resource", need=("dataset", "row_key", "resource"))
    def _w_set_embedding(self, q: dict):  # noqa: ANN202
        rid, space, v = _need(q, "resource_id", "space", "embedding")
        other = self.table("embeddings").filter((F.col("space") == space) & (F.size("embedding") != len(v)))
        if not v or not other.isEmpty():
            raise KbError("invalid", f"space {space} has another dimension")
        return [("embeddings", {"resource_id": rid, "space": space, "embedding": v})], {"id": rid}

    def _w_add_trajectory(self, q: dict):  # noqa: ANN202
        target, samples = _need(q, "target", "samples")
        tid = new_id("trj")
        return [("samples", {"target": target, "trajectory": tid, "frame": q.get("frame", "wgs84"), "how": q.get("how", "linear"), "t": s["t"], "x": s["x"], "y": s["y"], "z": s.get("z")}) for s in sorted(samples, key=lambda s: s["t"])], {"id": tid}

    def _w_create_branch(self, q: dict):  # noqa: ANN202
        (name,) = _need(q, "name")
        return [("branches", {"branch_id": q.get("id", name), "branch_name": name, "parent": q.get("parent", MAIN), "fork_seq": self.seq})], {"id": q.get("id", name)}

    def _w_materialize_branch(self, q: dict):  # noqa: ANN202
        n = self.materialize(q.get("branch", MAIN))
        return [], {"rows": n}

    def _w_add_table_rows(self, q: dict):  # noqa: ANN202
        ds, rows = _need(q, "dataset", "rows")
        d = self.table("datasets").filter(F.col("dataset") == ds).orderBy(F.desc("seq")).first()
        if d is None:
            raise KbError("not_found", ds)
        if any(r.get(k) is None for r in rows for k in d["pk"]):
            raise KbError("invalid", "rows must carry their key")
        return [("dataset_rows", {"dataset": ds, "row_key": "|".join(str(r[k]) for k in d["pk"]), "body": json.dumps(r)}) for r in rows], {"rows": len(rows)}

    # -- views

    def chain(self, branch: str = MAIN) -> list[tuple[str, int | None]]:
        """The branch and its ancestors, each with the last revision seen of it."""
        by = {r.branch_id: r for r in self.table("branches").collect()}  # a dimension: one row per branch made by hand
        out, limit, at = [(branch, None)], None, branch
        while at in by and len(out) < 64:
            limit = by[at].fork_seq if limit is None else min(limit, by[at].fork_seq)
            at = by[at].parent
            out.append((at, limit))
        if branch != MAIN and branch not in by:
            raise KbError("not_found", branch)
        return out

    def claims(self, view: dict | None = None) -> DataFrame:
        """Claims seen in a view: branch (with what it inherits), canon, timeline, as_known_at, status; with their status there."""
        v = view or {}
        seen = F.lit(False)
        for b, limit in self.chain(v.get("branch", MAIN)):
            seen = seen | ((F.col("branch_id") == b) if limit is None else (F.col("branch_id") == b) & (F.col("seq") <= limit))
        at = v.get("as_known_at")
        a = self.table("assertions").filter(seen)
        # evidence acquired before a claim was written makes it known earlier
        first = self.table("evidence").join(self.table("acquisitions").select("acquisition", "acquired_at"), "acquisition").groupBy("claim_id").agg(F.min("acquired_at").alias("_first"))
        a = a.join(first, "claim_id", "left").withColumn("first_known_at", F.least("first_known_at", "_first")).drop("_first")
        s = self.table("status_changes")
        of = a.select("claim_id", F.col("seq").alias("_made"), F.col("first_known_at").alias("_known"))
        s = s.join(of, "claim_id").withColumn("basis_at", F.when(F.col("seq") == F.col("_made"), F.least("basis_at", "_known")).otherwise(F.col("basis_at")))
        if at is not None:
            a, s = a.filter(F.col("first_known_at") <= at), s.filter(F.col("basis_at") <= at)
        now = s.groupBy("claim_id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), F.coalesce(F.bool_or("verified"), F.lit(False)).alias("human_verified"))
        out = a.join(now, "claim_id").filter(F.col("status").isin(*(v.get("status") or claims.LIVE)))
        for k in ("canon", "timeline"):
            if v.get(k):
                out = out.filter(F.col(k).isNull() | (F.col(k) == v[k]))
        who = claims.Principal(**v.get("principal", {}))
        return out.filter(who.sees(F.col("visibility")))

    def evidence(self) -> DataFrame:
        """What claims rest on: root, origin and reliability of the sources, confidence and models of the derivations."""
        src = self.table("sources").dropDuplicates(["source_id"]).select("source_id", F.coalesce("provenance_root", "source_id").alias("root"), "origin", "reliability")
        acq = self.table("acquisitions").dropDuplicates(["acquisition"]).select("acquisition", "source_id")
        return self.table("evidence").join(acq, "acquisition").join(src, "source_id").select("claim_id", "root", "origin", "reliability", F.lit(None).cast("double").alias("extraction_conf"), F.col("model").isNotNull().alias("ai"))

    def policy(self, key: str | None) -> claims.RankPolicy:
        if key is None:
            return claims.RankPolicy()
        row = self.table("rank_policies").filter(F.col("key") == key).orderBy(F.desc("seq")).first()
        if row is None:
            raise KbError("not_found", key)
        return claims.RankPolicy(**json.loads(row["body"]))

    def evaluated(self, view: dict | None = None, c: DataFrame | None = None) -> DataFrame:
        return claims.evaluate(self.claims(view) if c is None else c, self.policy((view or {}).get("rank_policy")), evidence=self.evidence())

    def summarized(self, ev: DataFrame) -> DataFrame:
        one = self.table("predicates").groupBy(F.col("key").alias("predicate")).agg(F.max_by("functional", F.when(F.col("functional").isNotNull(), F.col("seq"))).alias("f")).filter("f")
        return claims.summarize(ev, one)

    def redirects(self) -> DataFrame:
        ok = self.table("merge_decisions").filter("approved").select("merge_id").distinct()
        one = self.table("merge_proposals").join(ok, "merge_id").groupBy(F.col("from_id").alias("id")).agg(F.max_by("into_id", "seq").alias("into"))
        return graph.follow_redirects(one)

    def resources(self) -> DataFrame:
        w = W.partitionBy("resource_id").orderBy(F.desc("seq"))
        return self.table("resources").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

    def facts(self, view: dict | None = None) -> DataFrame:
        """One row per resource: label, types, rank, contested, preferred time, places with all that contain them."""
        ev = cut(self.evaluated(view))  # read by all that follows
        ranked = ev.groupBy(F.col("subject").alias("resource_id")).agg(F.max("rank").alias("rank"), F.min("first_known_at").alias("known_from"))
        cont = self.summarized(ev).groupBy(F.col("subject").alias("resource_id")).agg(F.bool_or("contested").alias("contested"))
        yes = ev.filter("not negated")
        when = claims.event_times(ev).withColumnRenamed("subject", "resource_id").drop("status")
        part = yes.filter(F.col("predicate").isin("part_of_work", "appears_in") & F.col("object.resource").isNotNull()).select(F.col("subject").alias("node"), F.col("object.resource").alias("up"))
        works = graph.closure(part).groupBy(F.col("node").alias("resource_id")).agg(F.array_sort(F.collect_set("above")).alias("works"))
        into = yes.filter(F.col("predicate").isin("located_in", "inside")).select(F.col("subject").alias("node"), F.col("object.resource").alias("up"))
        holds = yes.filter("predicate = 'contains'").select(F.col("object.resource").alias("node"), F.col("subject").alias("up"))
        above = graph.closure(into.unionByName(holds), max_depth=32)
        at = yes.filter(F.col("predicate").isin("took_place_at", "located_in", "inside", "birth_place", "death_place")).select(F.col("subject").alias("resource_id"), F.col("object.resource").alias("place")).filter("place is not null").distinct()
        anc = at.join(above.select(F.col("node").alias("place"), "above"), "place", "left").groupBy("resource_id").agg(F.array_sort(F.collect_set("place")).alias("places"), F.array_sort(F.array_union(F.collect_set("place"), F.collect_set("above"))).alias("place_ancestors"))
        ent = yes.filter("object.resource is not null").select(F.col("subject").alias("resource_id"), F.col("object.resource").alias("e"))
        ent = ent.unionByName(ent.select(F.col("e").alias("resource_id"), F.col("resource_id").alias("e"))).groupBy("resource_id").agg(F.array_sort(F.collect_set("e")).alias("entities"))
        place = self.table("placements").groupBy("resource_id").agg(F.max_by("placement", "seq").alias("placement"))
        # a resource without a placement of its own has that of its one most specific place
        given = at.join(place.select(F.col("resource_id").alias("place"), F.col("placement").alias("_pp")), "place").groupBy("resource_id").agg(F.count("*").alias("_n"), F.first("_pp").alias("_pp"), F.first("place").alias("_from")).filter("_n = 1")
        out = self.resources()
        for d in (ranked, cont, when, works, anc, ent, place, given):
            out = out.join(d, "resource_id", "left")
        inherited = F.col("placement").isNull() & F.col("_pp").isNotNull()
        return out.withColumn("placement_inherited_from", F.when(inherited, F.col("_from"))).withColumn("placement", F.coalesce("placement", "_pp")).withColumn("contested", F.coalesce("contested", F.lit(False))).withColumnRenamed("resource_id", "canonical_id").drop("_n", "_pp", "_from")

    def materialize(self, branch: str = MAIN) -> int:
        """Write the facts of a branch as a new version; readers follow the newest pointer."""
        name, seq = f"_projection-{branch}", self.seq
        p, folder = self._pointer(name), f"rows-{uuid.uuid4().hex}"
        at = self.files.at(f"base/{name}/{folder}")
        self.facts({"branch": branch}).withColumn("materialized_seq", F.lit(seq)).write.parquet(at)
        self._point(name, {**p, "dirs": []}, folder, seq)
        return self.spark.read.parquet(at).count()

    # -- reads

    def query(self, req: dict) -> dict:
        """results, with warnings and the time taken; budget_ms is required, and work beyond it is cancelled and reported as truncated."""
        f = getattr(self, f"_q_{req.get('op')}", None)
        self.warnings = []
        if f is None:
            raise KbError("invalid", f"unknown operation {req.get('op')!r}")
        (budget,) = _need(req, "budget_ms")
        sc, tag, began, late = self.spark.sparkContext, f"almagest-{uuid.uuid4().hex}", time.time(), threading.Event()
        sc.addJobTag(tag)
        timer = threading.Timer(budget / 1000, lambda: (late.set(), sc.cancelJobsWithTag(tag)))
        timer.start()
        try:
            out = f(req)
            results = [json.loads(r.j) for r in out.limit(self._limit(req, 1000, 10_000)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()] if isinstance(out, DataFrame) else out
        except Exception:
            if not late.is_set():
                raise
            results = []
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
        return {"results": results, "truncated": late.is_set(), "elapsed_ms": round((time.time() - began) * 1000), "freshness": {"head": self.seq}, "warnings": self.warnings}

    def _limit(self, q: dict, default: int, most: int = 500) -> int:
        return max(1, min(most, q.get("limit", default)))

    def _q_lookup(self, q: dict):  # noqa: ANN202
        r = self.resources()
        if q.get("id"):
            to = self.redirects().filter(F.col("id") == q["id"]).first()
            return r.filter(F.col("resource_id") == (to["final"] if to else q["id"])).withColumn("redirected_from", F.lit(q["id"] if to else None)).withColumn("ambiguous", F.lit(False))
        if q.get("external_id"):
            scheme, _, val = q["external_id"].partition(":")
            hit = r.filter(F.array_contains("external_ids", f"{scheme.lower()}:{val}"))
        else:
            n = text.normalize_label(F.lit(_need(q, "label")[0]))
            hit = r.filter((text.normalize_label(F.col("label")) == n) | F.exists(F.coalesce("aliases", F.array()), lambda a: text.normalize_label(a) == n))
        merged = self.redirects().select(F.col("id").alias("resource_id"))
        hit = hit.join(merged, "resource_id", "left_anti")
        return hit.withColumn("ambiguous", F.count("*").over(W.partitionBy()) > 1)

    def _subtypes(self, types: list[str]) -> DataFrame:
        """(type): the types asked for with all below them, built-in ones included; not_found for one that nothing knows."""
        own = self.table("types").select(F.col("type_key").alias("node"), F.explode_outer("parents").alias("up"))
        sub = graph.closure(own.unionByName(self.spark.createDataFrame(list(BUILTIN_TYPES.items()), "node string, up string")))
        asked = self.spark.createDataFrame([(t,) for t in types], "type string")
        used = self.table("resources").select(F.explode("types").alias("type"))
        strange = asked.join(sub.select(F.col("node").alias("type")), "type", "left_anti").join(self.table("types").select(F.col("type_key").alias("type")), "type", "left_anti").join(used, "type", "left_anti").first()
        if strange is not None:
            raise KbError("not_found", strange["type"])
        return asked.join(sub.select(F.col("above").alias("type"), "node"), "type").select(F.col("node").alias("type")).unionByName(asked).distinct()

    def _q_search(self, q: dict):  # noqa: ANN202
        p = self.facts(q)
        sp, t = q.get("space") or {}, q.get("time") or {}
        if q.get("types"):
            p = p.join(p.select("canonical_id", F.explode("types").alias("type")).join(small(self._subtypes(q["types"])), "type", "left_semi").select("canonical_id").distinct(), "canonical_id", "left_semi")
        for k, col in (("entities", "entities"), ("works", "works")):
            for e in q.get(k) or []:
                p = p.filter(F.array_contains(col, self._one(e)))
        near = sp.get("near")
        limit, order = self._limit(q, 20), q.get("order_by", "rank")
        s = search.Search(within_place=sp.get("within_place"), bbox=tuple(sp["bbox"]) if sp.get("bbox") else None, near=(*near["at"], near["radius"]) if near else None, include_inherited=bool(sp.get("include_inherited")),
                          text=q.get("text"), min_rank=q.get("min_rank"), contested_only=bool(q.get("contested_only")), order_by=order, limit=limit)
        for f in s.filters():
            p = p.filter(f)
        p = p.withColumn("matched_alternative_time", F.lit(False))
        if t:
            lo, hi = (parse(t.get(k), self.clock()) if t.get(k) else None for k in ("from", "to"))
            if t.get("expression"):
                lo = hi = parse(t["expression"], self.clock())
            qs = F.lit(lo.range.es if lo and lo.range else fuzzy.NEG_INF)
            qe = F.lit(hi.range.le if hi and hi.range else fuzzy.POS_INF)
            mode = t.get("mode", "possibly")
            test = {"possibly": fuzzy.possibly_overlaps, "certainly": fuzzy.certainly_overlaps, "within": fuzzy.lies_within}[mode]
            same = F.col("axis") == (q.get("calendar") or "gregorian")
            other = p.filter(~same & F.col("time").isNotNull()).count()
            if other:
                self.warnings.append(f"comparable: false for {other} rows on another axis")
            hit = same & test(F.col("time"), qs, qe)
            if mode == "possibly":  # claims that lost to the preferred one may still say so
                p = p.withColumn("matched_alternative_time", F.coalesce(same & ~hit & F.exists("alternatives", lambda a: fuzzy.possibly_overlaps(a, qs, qe)), F.lit(False)))
            undated = F.col("time").isNull() if t.get("include_undated") else F.lit(False)
            p = p.filter(F.coalesce(hit, F.lit(False)) | F.col("matched_alternative_time") | undated)
        score = s.relevance() if order == "relevance" else F.coalesce("rank", F.lit(0.0))
        if q.get("vector"):  # the nearest only
            close = self.nearest(*_need(q["vector"], "space", "embedding"), k=max(5 * limit, 100)).select(F.col("resource_id").alias("canonical_id"), F.col("score").alias("_cos"))
            p = p.join(F.broadcast(close), "canonical_id")  # k rows
            score = score + F.col("_cos") if order == "relevance" else score
        p = p.withColumn("score", F.round(score, 6))
        by = [F.col("time.es").asc_nulls_last()] if order == "time" else [F.desc("score")]
        return p.orderBy(*by, "canonical_id").limit(limit).select("canonical_id", "label", "types", "time", "axis", "matched_alternative_time", "places", "place_ancestors", "rank", "contested", "placement_inherited_from", "score")

    def _one(self, ref: str) -> str:
        """The id that an id or an external id stands for."""
        if ":" in ref:
            scheme, _, val = ref.partition(":")
            hit = self.resources().filter(F.array_contains("external_ids", f"{scheme.lower()}:{val}")).orderBy("resource_id").first()
            if hit is None:
                raise KbError("not_found", ref)
            ref = hit["resource_id"]
        to = self.redirects().filter(F.col("id") == ref).first()
        return to["final"] if to else ref

    def _q_similar(self, q: dict):  # noqa: ANN202
        return search.similar(self.facts(q), _need(q, "id")[0], limit=self._limit(q, 10))

    def _q_expand_claims(self, q: dict):  # noqa: ANN202
        (rid,) = _need(q, "id")
        v = {**q, "status": claims.STATUSES} if q.get("include_history") else q
        ids = F.lit(rid) if q.get("alone") else None
        group = self.redirects().filter(F.col("final") == rid).select(F.col("id").alias("subject")).unionByName(self.spark.createDataFrame([(rid,)], "subject string"))
        c = self.claims(v)
        c = c.filter(F.col("subject") == ids) if ids is not None else c.join(F.broadcast(group), "subject", "left_semi")
        if q.get("predicates"):
            c = c.filter(F.col("predicate").isin(*q["predicates"]))
        if q.get("valid_at") is not None:
            c = c.filter(F.col("valid_time").isNull() | F.col("es").isNull() | ((F.col("es") <= q["valid_at"]) & (F.col("le") > q["valid_at"])))
        e = self.evaluated(q, c)
        s = self.summarized(e).drop("subject")
        g = e.groupBy("predicate").agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("order"), "claim_id", "object", "negated", "status", "independent"))).alias("claims"))
        out = s.groupBy("predicate").agg(F.max("preferred").alias("preferred"), F.bool_or("contested").alias("contested")).join(g, "predicate", "right")
        if q.get("include_incoming"):
            inc = self.evaluated(q, self.claims(v).filter(F.col("object.resource") == rid)).orderBy(F.desc("rank"), "claim_id").limit(200)
            inc = inc.groupBy(F.concat(F.lit("incoming:"), "predicate").alias("predicate")).agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("order"), "claim_id", "object", "negated", "status", "independent"))).alias("claims"))
            out = out.unionByName(inc.select("predicate", F.lit(None).cast("string").alias("preferred"), F.lit(False).alias("contested"), "claims"))
        return out.orderBy("predicate")

    def _q_get_acquisition(self, q: dict):  # noqa: ANN202
        a = self.table("acquisitions").join(self.table("sources").drop("seq").dropDuplicates(["source_id"]), "source_id", "left")
        if q.get("assertion"):
            a = a.join(self.table("evidence").filter(F.col("claim_id") == q["assertion"]).select("acquisition", "claim_id", "extractor", "model"), "acquisition")
        else:
            a = a.filter(F.col("acquisition") == _need(q, "acquisition")[0])
        lic = self.table("licenses").groupBy(F.col("key").alias("license")).agg(F.max_by("redistributable", "seq").alias("redistributable"))
        a = a.join(lic, "license", "left").withColumn("withheld", ~F.coalesce("redistributable", F.lit(False)))
        if not q.get("include_snapshot"):
            return a.drop("seq")
        out = []
        for r in a.drop("seq").limit(self._limit(q, 20)).collect():
            row = r.asDict()
            snap = self.table("snapshots").filter(F.col("hash") == r["hash"]).first() if not r["withheld"] else None
            raw = self._opened(snap["body"], snap["key_id"]) if snap else None
            row["body"] = None if raw is None else raw[q.get("offset", 0) : q.get("offset", 0) + q.get("length", 65_536)].decode("utf-8", "replace")
            out.append(row)
        return out

    def _events(self, q: dict) -> DataFrame:
        e = self.table("events").filter(F.col("owner") == _need(q, "owner")[0])
        for k, col in (("conversations", "conversation"), ("kinds", "kind"), ("origins", "origin")):
            if q.get(k):
                e = e.filter(F.col(col).isin(*q[k]))
        if q.get("from") is not None:
            e = e.filter(F.col("received_at") >= q["from"])
        if q.get("to") is not None:
            e = e.filter(F.col("received_at") < q["to"])
        return e.withColumn("body", F.when(F.col("key_id").isNull(), F.unbase64("content").cast("string"))).drop("content", "seq")

    def _q_history_search(self, q: dict):  # noqa: ANN202
        e = self._events(q)
        n = text.normalize_label(F.col("body"))
        if q.get("exact"):
            e = e.filter(F.contains("body", F.lit(q["exact"]))).withColumn("at", F.instr("body", q["exact"]) - 1)
        elif q.get("text"):
            terms = " ".join(q["text"].lower().split()).split(" ")
            for t in terms:
                e = e.filter(F.contains(n, F.lit(t)))
            e = e.withColumn("at", F.instr(n, terms[0]) - 1)
        order = {"newest": [F.desc("received_at"), F.desc("event_id")], "oldest": ["received_at", "event_id"], "sequence": ["sequence", "event_id"]}[q.get("order", "newest")]
        if q.get("cursor"):
            key, last = q["cursor"]
            col = F.struct(F.col("sequence" if q.get("order") == "sequence" else "received_at"), F.col("event_id"))
            mark = F.struct(F.lit(key).cast("bigint"), F.lit(last))
            e = e.filter(col < mark) if q.get("order", "newest") == "newest" else e.filter(col > mark)
        return e.withColumn("excerpt", F.substring("body", 1, 160)).drop("body").orderBy(*order).limit(self._limit(q, 20, 200))

    def _q_history_get(self, q: dict):  # noqa: ANN202
        (eid,) = _need(q, "event_id")
        e = self.table("events").filter((F.col("owner") == _need(q, "owner")[0]) & (F.col("event_id") == eid)).first()
        if e is None:
            raise KbError("not_found", eid)
        raw, at = self._opened(e["content"], e["key_id"]), q.get("offset", 0)
        part = None if raw is None else raw[at : at + max(1, min(1 << 20, q.get("length", 65_536)))]
        while part and at + len(part) < len(raw) and (raw[at + len(part)] & 0xC0) == 0x80 and len(part) > 1:
            part = part[:-1]  # end on a whole character
        peers = self.table("events").filter((F.col("owner") == e["owner"]) & (((F.col("call_id") == e["call_id"]) & (F.col("event_id") != eid)) | (F.col("supersedes") == eid))).select("event_id").collect()
        return [{"event_id": eid, "hash": e["hash"], "size": None if raw is None else len(raw), "next_offset": None if part is None else at + len(part), "body": None if part is None else base64.b64encode(part).decode(), "withheld": raw is None, "related": sorted(r.event_id for r in peers)}]

    def _q_history_context(self, q: dict):  # noqa: ANN202
        conv, anchor = _need(q, "conversation", "sequence")
        e = self._events({**q, "conversations": [conv]})
        a = self.spark.createDataFrame([(conv, anchor)], "conversation string, anchor bigint")
        return series.context(e, key="conversation", seq="sequence", anchors=a, before=min(200, q.get("before", 5)), after=min(200, q.get("after", 5))).orderBy("sequence")

    def _q_history_conversations(self, q: dict):  # noqa: ANN202
        return series.conversation_stats(self._events(q), key="conversation", seq="sequence", at="received_at").orderBy(F.desc("last_at")).limit(self._limit(q, 50, 1000))

    def _q_temporal_relation(self, q: dict):  # noqa: ANN202
        a, b = _need(q, "a", "b")
        f = self.facts(q)
        x = f.filter(F.col("canonical_id") == a).select(F.col("time").alias("ta"), F.col("axis").alias("xa"))
        y = f.filter(F.col("canonical_id") == b).select(F.col("time").alias("tb"), F.col("axis").alias("xb"))
        mask = allen.possible_mask(F.col("ta"), F.col("tb"))
        j = x.crossJoin(y)  # one row each
        return j.select((F.col("xa") == F.col("xb")).alias("comparable"), F.when(F.col("xa") == F.col("xb"), allen.names(mask)).alias("possible"))

    def _q_timeline(self, q: dict):  # noqa: ANN202
        f = self.facts(q).filter(F.arrays_overlap("types", F.array(*[F.lit(t) for t in q.get("types", ["Event"])])))
        if q.get("entity"):
            f = f.filter(F.array_contains("entities", q["entity"]) | (F.col("canonical_id") == q["entity"]))
        if q.get("place"):
            f = f.filter(F.array_contains("place_ancestors", q["place"]))
        w = W.partitionBy("axis").orderBy("time.es", "time.le", "canonical_id")
        return f.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= self._limit(q, 50)).select("axis", "position", "canonical_id", "label", "time").orderBy("axis", "position")

    def _q_neighbors(self, q: dict):  # noqa: ANN202
        e = self.claims(q).filter("object.resource is not null").select(F.col("subject").alias("src"), F.col("object.resource").alias("dst"), "predicate", "status", "negated", "claim_id")
        if q.get("predicates"):
            e = e.filter(F.col("predicate").isin(*q["predicates"]))
        start = self.spark.createDataFrame([(_need(q, "id")[0],)], "node string")
        return graph.neighbours(e, start, depth=q.get("depth", 1), direction=q.get("direction", "both")).orderBy("step", "claim_id").limit(self._limit(q, 50))

    def _q_conflicts(self, q: dict):  # noqa: ANN202
        c = self.claims(q)
        c = c.filter(F.col("subject") == q["id"]) if q.get("id") else c
        e = self.evaluated(q, c)
        bad = self.summarized(e).filter("contested").select("subject", "predicate")
        return e.join(bad, ["subject", "predicate"], "left_semi").select("subject", "predicate", "claim_id", "object", "negated", "status", "rank").orderBy("subject", "predicate", F.desc("rank"), "claim_id").limit(self._limit(q, 50))

    def _q_freshness(self, q: dict):  # noqa: ANN202
        done = self._pointer(f"_projection-{q.get('branch', MAIN)}")["seq"]
        return [{"head": self.seq, "materialized": done, "behind": self.seq - done, "consistent": done == self.seq}]

    def _q_observations(self, q: dict):  # noqa: ANN202
        o = self.table("observations").filter(F.col("target") == _need(q, "target")[0])
        if q.get("metric"):
            o = o.filter(F.col("metric") == q["metric"])
        o = o.filter((F.col("observed_at") >= q.get("from", -(2**62))) & (F.col("observed_at") < q.get("to", 2**62)))
        if q.get("as_known_at") is not None:
            o = o.filter(F.coalesce("recorded_at", "observed_at") <= q["as_known_at"])
        return o.withColumn("count", F.count("*").over(W.partitionBy())).orderBy("metric", "observed_at", "obs_id").limit(self._limit(q, 1000, 10_000)).drop("seq")

    def _q_position_at(self, q: dict):  # noqa: ANN202
        target, at = _need(q, "target", "at")
        s = self.table("samples").filter(F.col("target") == target)
        span = s.groupBy("trajectory").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min("how").alias("how")).filter((F.col("a") <= at) & (F.col("b") >= at)).orderBy("a", "trajectory").first()
        if span is None:  # between two trajectories a target is nowhere
            return []
        s, out = s.filter(F.col("trajectory") == span["trajectory"]), None
        for c in ("x", "y", "z"):
            part = series.position_at(s.select("target", "t", F.col(c).alias("x")).filter("x is not null"), at, how=span["how"]).withColumnRenamed("x", c)
            out = part if out is None else out.join(part, "target", "left")
        return out

    def _q_sequence(self, q: dict):  # noqa: ANN202
        s = self.table("sequences").filter(F.col("scope") == _need(q, "scope")[0])
        s = s.filter(F.col("kind") == q["kind"]) if q.get("kind") else s
        return s.select("sequence", "kind", F.posexplode("items").alias("p", "item")).join(self.redirects().withColumnRenamed("id", "item"), "item", "left").select("sequence", "kind", (F.col("p") + 1).alias("position"), F.coalesce("final", "item").alias("item")).orderBy("sequence", "position")

    def _q_resolve_temporal(self, q: dict):  # noqa: ANN202
        p = parse(_need(q, "text")[0], q.get("reference", self.clock()), q.get("offset_min", 0))
        return [{"kind": p.kind, "range": None if p.range is None else p.range.__dict__, "reason": p.reason, "anchors": list(p.anchors), "rule": p.rule, "needs_reference": p.needs_reference}]

    def _q_resolve_spatial(self, q: dict):  # noqa: ANN202
        r = self.facts(q)
        if q.get("point"):
            x, y = q["point"]
            pl = F.col("placement")
            hit = r.filter((pl["minx"] <= x) & (pl["maxx"] >= x) & (pl["miny"] <= y) & (pl["maxy"] >= y)).withColumn("score", 1 / (1 + (pl["maxx"] - pl["minx"]) * (pl["maxy"] - pl["miny"])))
        else:
            (name,) = _need(q, "name")
            exact = text.normalize_label(F.col("label")) == text.normalize_label(F.lit(name))
            some = F.forall(text.tokens(F.lit(name)), lambda t: F.array_contains(text.tokens(F.col("label")), t))
            hit = r.filter(exact | some).withColumn("score", F.when(exact, 2.0).otherwise(1 + F.coalesce("rank", F.lit(0.0)) / 10))
        return hit.select("canonical_id", "label", "placement", "place_ancestors", "score").orderBy(F.desc("score"), "canonical_id").limit(self._limit(q, 10))

    def _q_merge_candidates(self, q: dict):  # noqa: ANN202
        open_ = self.table("merge_proposals").join(self.table("merge_decisions").select("merge_id"), "merge_id", "left_anti").select("from_id", "into_id", F.lit("proposed").alias("why"))
        pairs = self.claims(q).filter("predicate = 'possibly_same_as' and not negated").select(F.col("subject").alias("from_id"), canonical_id(F.col("object.resource")).alias("into_id"), F.lit("possibly_same_as").alias("why"))
        m = self.redirects()
        done = m.select(F.col("id").alias("from_id"), F.col("final").alias("into_id"))
        return open_.unionByName(pairs.join(done.unionByName(done.select(F.col("into_id").alias("from_id"), F.col("from_id").alias("into_id"))), ["from_id", "into_id"], "left_anti")).limit(self._limit(q, 50))

    def _q_derived_by(self, q: dict):  # noqa: ANN202
        e = self.table("evidence")
        for k in ("extractor", "model", "model_version"):
            e = e.filter(F.col(k) == q[k]) if q.get(k) else e
        return e.drop("seq").join(self.table("assertions").select("claim_id", "subject", "predicate"), "claim_id").orderBy("extracted_at", "claim_id").limit(self._limit(q, 100))

    def _q_vocabulary(self, q: dict):  # noqa: ANN202
        kind = _need(q, "kind")[0]
        if kind not in ("predicates", "types", "calendars", "frames"):
            raise KbError("invalid", f"unknown vocabulary {kind!r}")
        t = self.table(kind)
        key = "type_key" if kind == "types" else "key"
        rest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in t.columns if c not in (key, "seq")]  # the latest that was told
        return t.groupBy(key).agg(*rest).orderBy(key).limit(self._limit(q, 500))

    def _q_table_rows(self, q: dict):  # noqa: ANN202
        (ds,) = _need(q, "table")
        links = self.table("row_links").filter(F.col("dataset") == ds).groupBy("row_key").agg(F.array_sort(F.collect_set("resource")).alias("resources"))
        return self.table("dataset_rows").filter(F.col("dataset") == ds).select("row_key", "body").join(links, "row_key", "left").orderBy("row_key").limit(self._limit(q, 100))

    def _q_revisions(self, q: dict):  # noqa: ANN202
        return self.revisions().orderBy(F.desc("seq")).limit(self._limit(q, 20))

    # -- vectors and export

    def nearest(self, space: str, query: list[float], k: int = 10) -> DataFrame:
        w = W.partitionBy("resource_id").orderBy(F.desc("seq"))
        v = self.table("embeddings").filter(F.col("space") == space).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
        return vectors.top_k(v, query, k, id_col="resource_id")

    def export_ntriples(self) -> DataFrame:
        """Accepted, affirmed, public, redistributable and unconditional claims, one line each."""
        esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        lic = self.table("licenses").groupBy("key").agg(F.max_by("redistributable", "seq").alias("ok")).filter("ok").select(F.col("key").alias("license"))
        ok = lambda d: d.filter(F.col("license").isNull()).unionByName(d.join(lic, "license", "left_semi").select(*d.columns))
        c = ok(self.claims({"status": ["accepted"]}).filter("not negated and coalesce(visibility, 'public') = 'public' and valid_time is null and canon is null and timeline is null"))
        o = F.col("object")
        obj = F.when(o["kind"] == "resource", F.concat(F.lit("<urn:"), o["resource"], F.lit(">"))).when(o["kind"] == "text", F.concat(F.lit('"'), esc(o["text"]), F.lit('"'), F.coalesce(F.concat(F.lit("@"), o["lang"]), F.lit("")))).when(o["kind"] == "quantity", F.concat(F.lit('"'), o["amount"].cast("string"), F.coalesce(F.concat(F.lit(" "), o["unit"]), F.lit("")), F.lit('"'))).when(o["kind"] == "time", F.concat(F.lit('"'), esc(o["moment"]), F.lit('"')))
        lines = c.select(F.concat(F.lit("<urn:"), "subject", F.lit("> <urn:predicate:"), "predicate", F.lit("> "), obj, F.lit(" .")).alias("line"))
        labels = ok(self.resources().filter("coalesce(visibility, 'public') = 'public'")).select(F.concat(F.lit("<urn:"), "resource_id", F.lit('> <http://www.w3.org/2000/01/rdf-schema#label> "'), esc(F.col("label")), F.lit('" .')).alias("line"))
        return labels.unionByName(lines.filter("line is not null"))
