"""Text commands of the key-value side, one line each, for shells and scripts.

    put KEY VALUE [TTL] | put KEY @FILE | get KEY | del KEY | wipe PREFIX | has KEY | ttl KEY | scan [PREFIX] [LIMIT [OFFSET]] | rscan ...
    count [PREFIX] | rev count KEY | rev get KEY INDEX | pop [PREFIX] | use NS | namespaces | drop NS | stats | analyze | metrics
    dedup [on|off|clear] | batch put K V ; del K ; ... | flush | sync | compact | repair | dump PATH | destroy
    graph NAME EXPRESSION | push QUEUE BODY [TTL] | take QUEUE [N] | length QUEUE
"""

from __future__ import annotations

import shlex
from typing import Any

from strandlog.functions.scalars import key_of_token
from strandlog.plans.engine import DEFAULT, Engine

SCAN_LIMIT = 10


class Shell:
    def __init__(self, engine: Engine) -> None:
        self.engine, self.ns = engine, DEFAULT

    def _value(self, text: str) -> bytes | str:
        """`@path` reads a file through Spark, so that any store serves; `@@` stands for a leading @."""
        if text.startswith("@@"):
            return text[1:]
        if text.startswith("@"):
            return bytes(self.engine.spark.read.format("binaryFile").load(text[1:]).first().content)
        return text

    def run(self, line: str) -> Any:
        if line.split(None, 1)[:1] == ["graph"]:
            _, name, expression = line.split(None, 2)
            return self.engine.graph(name).run(expression)
        words = shlex.split(line)
        if not words:
            return None
        name, args = words[0].lower().replace("-", "_"), words[1:]
        found = getattr(self, f"do_{name}", None)
        if found is None:
            raise ValueError(f"unknown command: {words[0]}")
        return found(*args)

    @property
    def space(self):
        return self.engine.namespace(self.ns)

    def do_put(self, key: str, value: str, ttl: str | None = None) -> int:
        return self.space.put(key_of_token(key), self._value(value), ttl)

    def do_get(self, key: str) -> bytes | None:
        return self.space.get(key_of_token(key))

    def do_del(self, key: str) -> None:
        self.space.delete(key_of_token(key))

    def do_wipe(self, prefix: str) -> int:
        return self.space.delete_prefix(prefix)

    def do_has(self, key: str) -> bool:
        return self.space.exists(key_of_token(key))

    def do_ttl(self, key: str) -> int | None:
        return self.space.ttl(key_of_token(key))

    def do_scan(self, prefix: str = "", limit: str = str(SCAN_LIMIT), offset: str = "0", reverse: bool = False) -> list:
        start = int(prefix) if prefix.lstrip("-").isdigit() and self.space._ordered() else prefix
        return self.space.scan(start, int(limit), int(offset), reverse=reverse)

    def do_rscan(self, *args: str) -> list:
        return self.do_scan(*args, reverse=True)

    def do_count(self, prefix: str | None = None) -> int:
        return self.space.count(prefix)

    def do_rev(self, what: str, key: str, index: str = "0") -> Any:
        return self.space.rev_count(key_of_token(key)) if what == "count" else self.space.rev_get(key_of_token(key), int(index))

    def do_pop(self, prefix: str = "") -> Any:
        return self.space.pop_first(prefix)

    def do_use(self, ns: str) -> None:
        self.ns = ns

    def do_namespaces(self) -> list[str]:
        return self.engine.list_namespaces()

    def do_drop(self, ns: str) -> None:
        self.engine.drop_namespace(ns)

    def do_stats(self) -> list:
        return self.engine.stats().orderBy("ns").collect()

    do_analyze = do_stats

    def do_metrics(self) -> str:
        return self.engine.prometheus()

    def do_dedup(self, state: str | None = None) -> bool:
        if state is not None:
            self.engine.set_namespace_dedup(self.ns, {"on": True, "off": False, "clear": None}[state])
        return self.engine.dedup_enabled(self.ns)

    def do_batch(self, *words: str) -> int:
        ops, now = [], []
        for w in [*words, ";"]:
            if w != ";":
                now.append(w)
                continue
            if now:
                ops.append(("put", key_of_token(now[1]), self._value(now[2]), *now[3:4]) if now[0] == "put" else ("delete", key_of_token(now[1])))
            now = []
        return self.space.write_batch(ops)

    def do_flush(self) -> None:
        self.engine.flush()

    do_sync = do_flush

    def do_compact(self) -> None:
        self.engine.compact()

    def do_repair(self) -> dict:
        return self.engine.store.repair()

    def do_dump(self, path: str) -> None:
        self.space.dump(path)

    def do_destroy(self) -> None:
        self.engine.store.destroy()

    def do_push(self, queue: str, body: str, ttl: str | None = None) -> str:
        return self.engine.queue(queue).push(body, ttl)

    def do_take(self, queue: str, n: str = "1") -> list[str]:
        return self.engine.queue(queue).pop_batch(int(n))

    def do_length(self, queue: str) -> int:
        return len(self.engine.queue(queue))
