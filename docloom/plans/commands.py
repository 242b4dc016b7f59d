"""Requests as documents: ``run(db, {"find": "zips", "filter": {…}})``."""

from __future__ import annotations

import datetime as dt
from typing import Any

from ..functions.types import RequestError
from ..sources.catalog import Database
from ..sources.cursor import Cursor
from .metrics import measured

#: Answers that don't depend on data.
STATIC: dict[str, dict] = {
    "ping": {"ok": 1.0},
    "buildinfo": {"version": "2.6.0", "gitVersion": "docloom", "bits": 64, "maxBsonObjectSize": 16 << 20, "ok": 1.0},
    "getlog": {"totalLinesWritten": 0, "log": [], "ok": 1.0},
    "replsetgetstatus": {"ok": 0.0, "errmsg": "not running with --replSet"},
    "getlasterror": {"n": 0, "connectionId": 0, "err": None, "ok": 1.0},
    "whatsmyuri": {"you": "local", "ok": 1.0},
}


class Session:
    """A database with the cursors that are open on it."""

    def __init__(self, database: Database) -> None:
        self.database = database
        self.cursors: dict[int, Cursor] = {}

    def run(self, command: dict) -> dict:
        """The answer to a command; its name is the document's first key.  Unknown or wrong ones raise."""
        if not command:
            raise RequestError("an empty command")
        name = next(iter(command))
        key = name.lower()
        if key == "ismaster":
            return {"ismaster": True, "maxBsonObjectSize": 16 << 20, "localTime": dt.datetime.now(dt.timezone.utc), "maxWireVersion": 2, "minWireVersion": 0, "ok": 1.0}
        if key in STATIC:
            return dict(STATIC[key])
        handler = getattr(self, f"_{key}", None)
        if handler is None:
            raise RequestError(f"unknown command {name}")
        return handler(command[name], command)

    def _insert(self, name: str, c: dict) -> dict:
        return {"ok": 1.0, "n": self.database[name].insert_many(list(c["documents"]))}

    def _find(self, name: str, c: dict) -> dict:
        df = self.database[name].find(c.get("filter"), c.get("projection"), c.get("sort"), c.get("skip", 0), c.get("limit", 0))
        return self._opened(df, name, c.get("batchSize", 101))

    def _aggregate(self, name: str, c: dict) -> dict:
        return self._opened(self.database[name].aggregate(c["pipeline"]), name, c.get("cursor", {}).get("batchSize", 101))

    def _count(self, name: str, c: dict) -> dict:
        return {"n": self.database[name].count(c.get("query")), "ok": 1.0}

    def _distinct(self, name: str, c: dict) -> dict:
        """Values come back in one answer, as clients expect; for many, use Collection.distinct."""
        return {"values": [r["value"] for r in self.database[name].distinct(c["key"], c.get("query")).toLocalIterator()], "ok": 1.0}

    def _delete(self, name: str, c: dict) -> dict:
        return {"n": sum(self.database[name].delete_many(d["q"]) for d in c["deletes"]), "ok": 1.0}

    def _update(self, name: str, c: dict) -> dict:
        return {"n": sum(self.database[name].update_many(u["q"], u["u"]) for u in c["updates"]), "ok": 1.0}

    def _explain(self, request: dict, c: dict) -> dict:
        """Runs a find or aggregate and says what it took."""
        if "find" in request:
            name = request["find"]
            df = self.database[name].find(request.get("filter"), request.get("projection"), request.get("sort"), request.get("skip", 0), request.get("limit", 0))
        elif "aggregate" in request:
            name = request["aggregate"]
            df = self.database[name].aggregate(request["pipeline"])
        else:
            raise RequestError("explain takes a find or an aggregate")
        return {"namespace": f"{self.database.name}.{name}", "executionStats": measured(df).as_reply(), "ok": 1.0}

    def _mapreduce(self, name: str, c: dict) -> dict:
        raise RequestError("mapReduce runs functions of JavaScript, which are not run here; $group and $where say the same")

    def _getmore(self, cursor_id: int, c: dict) -> dict:
        cursor = self.cursors.get(cursor_id)
        if cursor is None:
            raise RequestError(f"there is no cursor {cursor_id}")
        batch = cursor.next_batch(c.get("batchSize"))
        return {"cursor": {"id": self._left(cursor), "ns": cursor.namespace, "nextBatch": batch}, "ok": 1.0}

    def _killcursors(self, name: str, c: dict) -> dict:
        killed = [i for i in c["cursors"] if i in self.cursors]
        for i in killed:
            self.cursors.pop(i).close()
        return {"cursorsKilled": killed, "cursorsNotFound": [i for i in c["cursors"] if i not in killed], "ok": 1.0}

    def _opened(self, df: Any, name: str, batch_size: int) -> dict:
        cursor = Cursor(df, f"{self.database.name}.{name}", batch_size)
        self.cursors[cursor.id] = cursor
        batch = cursor.next_batch()
        return {"cursor": {"id": self._left(cursor), "ns": cursor.namespace, "firstBatch": batch}, "ok": 1.0}

    def _left(self, cursor: Cursor) -> int:
        if cursor.exhausted:
            self.cursors.pop(cursor.id, None)
            return 0
        return cursor.id
