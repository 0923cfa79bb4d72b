"""Synthetic load: scripted lifecycles, telemetry of a fleet, and a simulated workshop as a data source.

The scripted forms are column expressions over entities. The simulation is a state machine that events
run through in an order of its own; it is a Python data source whose partitions are workers, each with
its own share of the load and its own ids.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.columns import entity_id, iso_instant

#: Fixed values.
RECIPES = [("healing-elixir", "healing-elixir-v2"), ("mana-tonic", "mana-tonic-v1"), ("night-vision-draught", "night-vision-v3")]
REAGENTS = ["mandrake-root", "moonwater", "phoenix-ash"]
SCRIPT_STEPS = [
    (1, "ADD_GARLIC", "Add garlic; brew until tiny bubbles appear.", 25),
    (2, "UNICORN_HORN_POWDER", "Add unicorn horn powder; stir counterclockwise.", 55),
    (3, "SETTLE", "Let the surface settle to silver ripples.", 85),
]
STEP_TEMPLATES = [
    ("ADD_GARLIC", "Add garlic; brew until tiny bubbles appear."),
    ("UNICORN_HORN_POWDER", "Add unicorn horn powder; stir counterclockwise."),
    ("SILVER_RIPPLE_SETTLE", "Let the surface settle to silver ripples."),
    ("MOONWATER_DRIZZLE", "Drizzle moonwater along the cauldron rim."),
    ("PHOENIX_ASH_FOLD", "Fold phoenix ash into the vortex."),
    ("MANDRAKE_STEEP", "Steep mandrake root until the brew hums."),
    ("CRYSTAL_CHIME", "Chime the calibration crystal three times."),
    ("VAPOR_BINDING", "Bind violet vapor with a clockwise sweep."),
    ("EMBER_REST", "Lower embers and rest the surface."),
    ("FINAL_STIR", "Finish with a slow figure-eight stir."),
]


# --- scripted lifecycles


def scripted_order_events(batches: DataFrame) -> DataFrame:
    """Four events of each order of a batch: created, assigned, waiting for bottling, completed.

    batches: batch_id, potion_id, recipe_id, started_ms, brew_ms, orders (array of order_id,
    customer_id, created_ms). Columns: order_id, batch_id, potion_id, recipe_id, customer_id, event_type,
    occurred_ms, occurred_at, detail (JSON of the payload).
    """
    rows = batches.select("batch_id", "potion_id", "recipe_id", "started_ms", "brew_ms", F.posexplode("orders").alias("place", "o"))
    start, brewed = F.col("started_ms"), F.col("started_ms") + F.col("brew_ms")
    own, none = F.col("batch_id"), F.lit("")
    done = brewed + 10_000 + F.col("place") * 25

    def event(kind: str, at: Column, batch: Column, **payload: Column) -> Column:
        return F.struct(F.lit(kind).alias("event_type"), at.cast("bigint").alias("occurred_ms"), batch.alias("batch"), F.to_json(F.struct(*(v.alias(k) for k, v in payload.items()))).alias("detail"))

    bottle = F.concat(F.lit("bottle-"), own, F.lit("-"), F.col("o.order_id"))
    events = F.array(
        event("ORDER_CREATED", F.col("o.created_ms"), none, recipe_id=F.col("recipe_id"), potion_id=F.col("potion_id"), bottle_size_ml=F.lit(750), requested_at=iso_instant("o.created_ms")),
        event("ORDER_BATCH_ASSIGNED", start + 3000, own, batch_id=own, assigned_at=iso_instant(start + 3000)),
        event("ORDER_WAITING_FOR_BOTTLING", brewed, own, batch_id=own, brewing_completed_at=iso_instant(brewed)),
        event("ORDER_COMPLETED", done, own, batch_id=own, bottle_id=bottle, bottled_at=iso_instant(done)),
    )
    rows = rows.select(F.col("o.order_id").alias("order_id"), "potion_id", "recipe_id", F.col("o.customer_id").alias("customer_id"), F.explode(events).alias("e"))
    return rows.select(
        "order_id", F.col("e.batch").alias("batch_id"), "potion_id", "recipe_id", "customer_id", "e.event_type", "e.occurred_ms",
        iso_instant("e.occurred_ms").alias("occurred_at"), "e.detail",
    )


def scripted_batch_events(batches: DataFrame) -> DataFrame:
    """Twelve events of each batch at fixed offsets from its start and from the end of brewing.

    batches as for scripted_order_events(), with cauldron_id. The cauldron is blank before it is assigned.
    """
    start, brewed = F.col("started_ms"), F.col("started_ms") + F.col("brew_ms")
    cauldron, none = F.col("cauldron_id"), F.lit("")
    steps = [("BATCH_BREWING_STEP_COMPLETED", start + at * 1000, cauldron, n, code) for n, code, _, at in SCRIPT_STEPS]
    script = [
        ("BATCH_CREATED", start, none, None, None),
        ("BATCH_REAGENTS_PREPARATION_STARTED", start + 1000, none, None, None),
        ("BATCH_REAGENTS_PREPARED", start + 2000, none, None, None),
        ("BATCH_CAULDRON_REQUESTED", start + 3000, none, None, None),
        ("BATCH_CAULDRON_ASSIGNED", start + 4000, cauldron, None, None),
        ("BATCH_BREWING_STARTED", start + 5000, cauldron, None, None),
        *steps,
        ("BATCH_BREWING_COMPLETED", brewed, cauldron, None, None),
        ("BATCH_BOTTLING_STARTED", brewed + 2000, cauldron, None, None),
        ("BATCH_BOTTLING_COMPLETED", brewed + 12_000, cauldron, None, None),
    ]
    events = F.array(
        *(
            F.struct(
                F.lit(place).alias("place"), F.lit(kind).alias("event_type"), at.cast("bigint").alias("occurred_ms"), where.alias("cauldron_id"),
                F.lit(n).cast("bigint").alias("step_number"), F.lit(code).cast("string").alias("step_code"),
            )
            for place, (kind, at, where, n, code) in enumerate(script)
        )
    )
    ids = F.transform("orders", lambda o: o["order_id"])
    rows = batches.select("batch_id", "potion_id", "recipe_id", ids.alias("order_ids"), F.explode(events).alias("e"))
    return rows.select(
        "batch_id", "potion_id", "recipe_id", "e.cauldron_id", "order_ids", "e.event_type", "e.step_number", "e.step_code",
        "e.place", "e.occurred_ms", iso_instant("e.occurred_ms").alias("occurred_at"),
    )


def recipe_of(sequence: Column) -> tuple[Column, Column]:
    """(potion_id, recipe_id) by turns."""
    slot = F.pmod(sequence, F.lit(len(RECIPES)))
    pick = lambda k: F.coalesce(*(F.when(slot == n, F.lit(r[k])) for n, r in enumerate(RECIPES)))
    return pick(0), pick(1)


def telemetry_row(sample: Column, blob_size: int = 512) -> dict[str, Column]:
    """Readings of the sample-th telemetry: a slow wave, fuel burning down, soot building up."""
    wave = F.sin(sample.cast("double") / 4.0)
    digits = F.transform(F.sequence(F.lit(0), F.lit(max(0, blob_size - 1))), lambda k: F.lpad(F.hex(F.pmod(sample + k, F.lit(256)).cast("bigint")), 2, "0"))
    return {
        "temperature_c": 88.0 + wave * 6.0,
        "density_sg": 1.12 + wave * 0.04,
        "bubble_rate_hz": 7.5 + wave * 1.2,
        "fuel_level_pct": F.greatest(65.0 - sample * 0.4, F.lit(5.0)),
        "soot_index": F.least(0.2 + sample * 0.01, F.lit(0.95)),
        "diagnostics_blob": F.unhex(F.concat_ws("", digits)) if blob_size else F.lit(b""),
    }


def fleet(spark: SparkSession, size: int, shard: int = 0, worker: int = 0) -> DataFrame:
    """slot, cauldron_id, batch_id, order_id, customer_id, potion_id, recipe_id of a fixed fleet."""
    n = F.col("id") + 1
    potion, recipe = recipe_of(n)
    return spark.range(size).select(
        F.col("id").alias("slot"),
        entity_id("cauldron", n, 4, shard, worker).alias("cauldron_id"),
        entity_id("fleet-batch", n, 8, shard, worker).alias("batch_id"),
        entity_id("fleet-order", n, 8, shard, worker).alias("order_id"),
        entity_id("fleet-customer", n, 8, shard, worker).alias("customer_id"),
        potion.alias("potion_id"),
        recipe.alias("recipe_id"),
    )


def fleet_warm_up(units: DataFrame, at_ms: int) -> DataFrame:
    """Three batch events a unit before the load starts."""
    kinds = ("BATCH_CREATED", "BATCH_CAULDRON_ASSIGNED", "BATCH_BREWING_STARTED")
    kind = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(t).alias("event_type")) for k, t in enumerate(kinds)))).alias("e")
    return units.select("batch_id", "potion_id", "recipe_id", "cauldron_id", F.array("order_id").alias("order_ids"), kind).select(
        "batch_id", "potion_id", "recipe_id", "cauldron_id", "order_ids", "e.event_type", "e.place", F.lit(at_ms).cast("bigint").alias("occurred_ms")
    )


def fleet_telemetry(ticks: DataFrame, units: DataFrame, size: int, blob_size: int = 512) -> DataFrame:
    """Telemetry by turns over the fleet. ticks: sequence (from 0), occurred_ms.

    A unit's batch keeps its readings at sample 0: the load's generator never moves them on.
    """
    rows = ticks.withColumn("slot", F.pmod("sequence", F.lit(size))).join(units.select("slot", "cauldron_id", "batch_id"), "slot")
    return rows.select("sequence", "cauldron_id", "batch_id", "occurred_ms", *(v.alias(k) for k, v in telemetry_row(F.lit(0), blob_size).items()))


def active_turns(ticks: DataFrame, active: DataFrame) -> DataFrame:
    """ticks (sequence) with the active unit whose turn it is; active: place (from 0), cauldron_id, batch_id."""
    counted = active.agg(F.count("*").alias("n"))
    rows = ticks.crossJoin(F.broadcast(counted)).where("n > 0").withColumn("place", F.pmod("sequence", F.col("n"))).drop("n")
    return rows.join(active, "place").drop("place")


def rate_stream(spark: SparkSession, rows_per_second: int, ramp_up_seconds: int = 0, partitions: int = 1) -> DataFrame:
    """An endless stream of timestamp and value at a rate."""
    return (
        spark.readStream.format("rate")
        .option("rowsPerSecond", rows_per_second)
        .option("rampUpTime", f"{ramp_up_seconds}s")
        .option("numPartitions", partitions)
        .load()
    )


# --- the simulated workshop

TOPIC_OF = {"order": "order.events.v1", "batch": "batch.events.v1", "telemetry": "cauldron.events.v1"}
#: Batch stages in order; a batch event moves a batch from one to the next. Fixed values.
STAGES = [
    ("batch_reagents_preparation_started", "created", "preparing"),
    ("batch_reagents_prepared", "preparing", "prepared"),
    ("batch_cauldron_requested", "prepared", "waiting_cauldron"),
    ("batch_cauldron_assigned", "waiting_cauldron", "cauldron_assigned"),
    ("batch_brewing_started", "cauldron_assigned", "brewing"),
    ("batch_brewing_step_completed", "brewing", "brewing"),
    ("batch_brewing_completed", "brewing_completed", "waiting_bottling"),
    ("batch_bottling_started", "waiting_bottling", "bottling"),
    ("batch_bottling_completed", "bottling", "done"),
]


@dataclass(frozen=True)
class Load:
    """What a simulated load is like; the defaults are the usual ones."""

    base_tps: int = 10_000
    order_percent: int = 40
    batch_percent: int = 20
    telemetry_percent: int = 40
    cauldrons: int = 32
    min_orders: int = 3
    max_orders: int = 8
    min_steps: int = 5
    max_steps: int = 10
    burst_every: int = 1
    min_burst: int = 5
    max_burst: int = 10
    most_at_once: int = 1000
    fixed_fleet: bool = False

    def __post_init__(self) -> None:
        if self.base_tps <= 0 or self.cauldrons <= 0 or self.most_at_once <= 0:
            raise ValueError("rates and counts must be positive")
        if self.order_percent + self.batch_percent + self.telemetry_percent != 100:
            raise ValueError("the percentages must make 100")
        for low, high in ((self.min_orders, self.max_orders), (self.min_steps, self.max_steps), (self.min_burst, self.max_burst)):
            if not 0 < low <= high:
                raise ValueError("a range goes from a positive least to a greatest")


@dataclass
class Batch:
    batch_id: str
    orders: list[str]
    steps: int
    cauldron: int | None = None
    done_steps: int = 0
    completed: int = 0


@dataclass
class Workshop:
    """One worker's state: queues of orders and batches, and the cauldrons.

    emit(name, now) makes the event asked for. Where nothing is ready for it, the event that would make
    something ready is emitted first, and so on down to new orders, to a depth that the load bounds.
    """

    load: Load
    shard: int = 0
    worker: int = 0
    queues: dict[str, deque] = field(default_factory=dict)
    out: list[tuple[str, str, str, int]] = field(default_factory=list)
    sequence: dict[str, int] = field(default_factory=lambda: {"order": 0, "batch": 0, "step": 0})
    busy: dict[int, Batch] = field(default_factory=dict)
    cursor: int = 0
    turn: int = 0

    def queue(self, name: str) -> deque:
        return self.queues.setdefault(name, deque())

    def ident(self, prefix: str, n: int, width: int) -> str:
        return f"{prefix}-{self.shard}-{self.worker}-{n:0{width}d}"

    def send(self, stream: str, key: str, event_type: str, now: int) -> None:
        self.out.append((TOPIC_OF[stream], key, event_type, now))

    def weights(self) -> dict[str, tuple[str, float]]:
        """Generators: name -> (stream, weight)."""
        steps = (self.load.min_steps + self.load.max_steps) / 2
        names = {n: ("order", 1.0) for n in ("order_created", "order_batch_assigned", "order_waiting_for_bottling", "order_completed")}
        names["batch_created"] = ("batch", 1.0)
        names |= {n: ("batch", steps if n == "batch_brewing_step_completed" else 1.0) for n, _, _ in STAGES}
        return names | {"cauldron_telemetry": ("telemetry", 1.0)}

    def emit(self, name: str, now: int, depth: int = 0) -> bool:
        if depth > self.load.max_steps + self.load.max_orders + 16:
            return False
        if name == "order_created":
            self.sequence["order"] += 1
            order = self.ident("order", self.sequence["order"], 10)
            self.queue("orders_created").append(order)
            self.send("order", order, "ORDER_CREATED", now)
            return True
        if name == "cauldron_telemetry":
            return self._telemetry(now, depth)
        if name == "batch_created":
            return self._create_batch(now)
        if name.startswith("order_"):
            return self._order(name, now, depth)
        return self._advance(name, now, depth)

    def _ready(self, take: Callable[[], object | None], before: str, now: int, depth: int, times: int = 1) -> object | None:
        """What take() gives, after emitting what it waits for up to `times` times."""
        found = take()
        for _ in range(times):
            if found is not None or not self.emit(before, now, depth + 1):
                break
            found = take()
        return found

    def _order(self, name: str, now: int, depth: int) -> bool:
        queue, before, after = {
            "order_batch_assigned": ("orders_assigned", "batch_created", None),
            "order_waiting_for_bottling": ("orders_waiting", "batch_brewing_completed", "orders_completable"),
            "order_completed": ("orders_completable", "order_waiting_for_bottling", None),
        }[name]
        found = self._ready(lambda: self._pop(queue), before, now, depth)
        if found is None:
            return False
        order, batch = found
        if after:
            self.queue(after).append(found)
        if name == "order_completed":
            batch.completed += 1
        self.send("order", order, name.upper(), now)
        return True

    def _pop(self, name: str):
        queue = self.queue(name)
        return queue.popleft() if queue else None

    def _create_batch(self, now: int) -> bool:
        load = self.load
        n = load.min_orders + now % (load.max_orders - load.min_orders + 1)
        steps = load.min_steps + now // 17 % (load.max_steps - load.min_steps + 1)
        waiting = self.queue("orders_created")
        while len(waiting) < n:
            self.emit("order_created", now)
        self.sequence["batch"] += 1
        batch = Batch(self.ident("batch", self.sequence["batch"], 8), [waiting.popleft() for _ in range(n)], steps)
        self.queue("created").append(batch)
        self.queue("orders_assigned").extend((o, batch) for o in batch.orders)
        self.send("batch", batch.batch_id, "BATCH_CREATED", now)
        return True

    def _advance(self, name: str, now: int, depth: int) -> bool:
        place = [n for n, _, _ in STAGES].index(name)
        _, source, target = STAGES[place]
        before = STAGES[place - 1][0] if place else "batch_created"
        if name == "batch_cauldron_assigned":
            return self._assign(now, depth)
        if name == "batch_bottling_completed":
            batch = self._ready(self._bottled, "batch_bottling_started", now, depth)
            if batch is None:
                batch = self._ready(self._bottled, "order_completed", now, depth, self.load.max_orders)
        elif name == "batch_brewing_completed":
            batch = self._ready(lambda: self._pop(source), before, now, depth, self.load.max_steps)
        else:
            batch = self._ready(lambda: self._pop(source), before, now, depth)
        if batch is None:
            return False
        if name == "batch_brewing_step_completed":
            self._steps(batch, now)
            return True
        if name == "batch_brewing_completed":
            self.busy.pop(batch.cauldron, None)
            self.queue("orders_waiting").extend((o, batch) for o in batch.orders)
        self.queue(target).append(batch) if target != "done" else None
        self.send("batch", batch.batch_id, name.upper(), now)
        return True

    def _bottled(self) -> Batch | None:
        queue = self.queue("bottling")
        for _ in range(len(queue)):
            batch = queue.popleft()
            if batch.completed >= len(batch.orders):
                return batch
            queue.append(batch)
        return None

    def _assign(self, now: int, depth: int) -> bool:
        batch = self._ready(lambda: self._pop("waiting_cauldron"), "batch_cauldron_requested", now, depth)
        if batch is None:
            return False
        free = next((k for k in range(self.load.cauldrons) if k not in self.busy), None)
        if free is None and self.emit("batch_brewing_completed", now, depth + 1):
            free = next((k for k in range(self.load.cauldrons) if k not in self.busy), None)
        if free is None:
            self.queue("waiting_cauldron").append(batch)
            return False
        batch.cauldron = free
        self.busy[free] = batch
        self.queue("cauldron_assigned").append(batch)
        self.send("batch", batch.batch_id, "BATCH_CAULDRON_ASSIGNED", now)
        return True

    def _steps(self, batch: Batch, now: int) -> None:
        load = self.load
        self.sequence["step"] += 1
        burst = 1
        if load.burst_every and self.sequence["step"] % load.burst_every == 0:
            burst = load.min_burst + now // 31 % (load.max_burst - load.min_burst + 1)
        for _ in range(min(burst, batch.steps - batch.done_steps)):
            batch.done_steps += 1
            self.send("batch", batch.batch_id, "BATCH_BREWING_STEP_COMPLETED", now)
        self.queue("brewing_completed" if batch.done_steps >= batch.steps else "brewing").append(batch)

    def _telemetry(self, now: int, depth: int) -> bool:
        if self.load.fixed_fleet:
            self.send("telemetry", self.ident("cauldron", self.turn % self.load.cauldrons + 1, 4), "CAULDRON_TELEMETRY", now)
            self.turn += 1
            return True
        if not self.busy and not self.emit("batch_brewing_started", now, depth + 1):
            return False
        after = [k for k in sorted(self.busy) if k >= self.cursor]
        at = after[0] if after else min(self.busy)
        self.cursor = (at + 1) % self.load.cauldrons
        self.send("telemetry", self.ident("cauldron", at + 1, 4), "CAULDRON_TELEMETRY", now)
        return True

    def counts(self) -> dict[str, int]:
        """How much stands in each queue."""
        names = ["orders_created", "orders_assigned", "orders_waiting", "orders_completable", "created"]
        names += [t for _, _, t in STAGES if t != "done"] + ["brewing_completed"]
        return {n: len(self.queue(n)) for n in dict.fromkeys(names)} | {"cauldrons_active": len(self.busy)}


def due_events(load: Load, weights: dict[str, tuple[str, float]], rate_of: Callable[[float], float | None], step_seconds: float = 0.1) -> Iterator[tuple[float, str, int]]:
    """(second, generator, events due) until the profile ends: permits accrue under the rate as a trapezoid."""
    share = {"order": load.order_percent, "batch": load.batch_percent, "telemetry": load.telemetry_percent}
    total = {s: sum(w for t, w in weights.values() if t == s) for s in share}
    permits, last, k = dict.fromkeys(weights, 0.0), dict.fromkeys(weights, 0.0), 0
    while (base := rate_of(k * step_seconds)) is not None:
        for name, (stream, weight) in weights.items():
            rate = base * share[stream] / 100 * weight / total[stream]
            permits[name] += (last[name] + rate) / 2 * (step_seconds if k else 0.0)
            last[name] = rate
            while (due := min(math.floor(permits[name]), load.most_at_once)) > 0:
                permits[name] -= due
                yield k * step_seconds, name, due
        k += 1


class _Worker(InputPartition):
    def __init__(self, shard: int, worker: int):
        self.shard, self.worker = shard, worker


class LoadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        from tidemark.operators.experiments import parse_load_profile

        self.phases = parse_load_profile(options.get("profile", "0 -> (10s, warmup) -> 100 -> (20s, maximum) -> 100"))
        self.workers, self.shard = int(options.get("workers", 1)), int(options.get("shard", 0))
        self.start_ms = int(options.get("start_ms", 0))
        given = json.loads(options.get("load", "{}"))
        self.load = Load(**given)
        if self.workers <= 0:
            raise ValueError("workers must be positive")
        self.workers = min(self.workers, self.load.base_tps)

    def partitions(self) -> list[_Worker]:
        return [_Worker(self.shard, k) for k in range(self.workers)]

    def rate(self, worker: int, second: float) -> float | None:
        base = self.load.base_tps // self.workers + (worker < self.load.base_tps % self.workers)
        for p in self.phases:
            end = p["start_seconds"] + p["duration_seconds"]
            if second < end:
                share = (second - p["start_seconds"]) / p["duration_seconds"]
                return base * (p["start_percent"] + (p["end_percent"] - p["start_percent"]) * share) / 100
        return None

    def read(self, partition: _Worker) -> Iterator[tuple]:
        shop = Workshop(self.load, partition.shard, partition.worker)
        for second, name, due in due_events(self.load, shop.weights(), lambda s: self.rate(partition.worker, s)):
            now = self.start_ms + round(second * 1000)
            emitted = 0
            while emitted < due:
                before = len(shop.out)
                shop.emit(name, now)
                emitted += max(1, len(shop.out) - before if name == "batch_brewing_step_completed" else 1)
            for topic, key, event_type, at in shop.out:
                yield partition.worker, topic, key, event_type, at
            shop.out.clear()


class LoadSource(DataSource):
    """spark.read.format("workshop_load"): worker, topic, key, event_type, occurred_ms of a simulated load.

    Options: profile, workers, shard, start_ms, load (JSON of Load's fields).
    """

    @classmethod
    def name(cls) -> str:
        return "workshop_load"

    def schema(self) -> str:
        return "worker int, topic string, key string, event_type string, occurred_ms bigint"

    def reader(self, schema) -> LoadReader:
        return LoadReader(dict(self.options))


def simulated_load(spark: SparkSession, profile: str, workers: int = 1, start_ms: int = 0, **load) -> DataFrame:
    spark.dataSource.register(LoadSource)
    reader = spark.read.format("workshop_load").option("profile", profile).option("workers", workers).option("start_ms", start_ms)
    return reader.option("load", json.dumps(load)).load()
