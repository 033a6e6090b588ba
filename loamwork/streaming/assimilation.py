"""An ensemble on a grid, by tile, that observations move in event time: as a stream with state and as one batch."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps state by key with timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEP = "tile {kind}, t timestamp, row int, col int, mean double, sd double, n_obs int"


def compact_taper(z: np.ndarray) -> np.ndarray:
    """A weight that falls from 1 at distance 0 to 0 at twice the radius, by distance over radius."""
    near = 1 - 5 / 3 * z**2 + 5 / 8 * z**3 + z**4 / 2 - z**5 / 4
    far = 4 - 5 * z + 5 / 3 * z**2 + 5 / 8 * z**3 - z**4 / 2 + z**5 / 12 - 2 / (3 * np.maximum(z, 1e-12))
    return np.maximum(0, np.where(z <= 1, near, np.where(z <= 2, far, 0)))


def moved(values: np.ndarray, cells: np.ndarray, at: np.ndarray, observed: np.ndarray, sd: np.ndarray, radius: float | None, noise: np.ndarray) -> np.ndarray:
    """values (members x cells) after observations at the cells `at`, each member by its own perturbed ones.

    The gain comes from the members' deviations alone; with a radius it is tapered by the distance of cell and
    observation.
    """
    n = max(1, len(values) - 1)
    away = values - values.mean(axis=0)
    seen = away[:, at]
    gain = np.linalg.solve(seen.T @ seen / n + np.diag(sd**2), seen.T @ away / n)  # observations x cells
    if radius is not None:
        gain = gain * compact_taper(np.sqrt(((cells[at][:, None] - cells[None]) ** 2).sum(axis=-1)) / radius)
    return values + (observed + noise - values[:, at]) @ gain


class Tile:
    """The ensemble of one tile: cells (row, col) in order, values (members x cells)."""

    def __init__(self, cells: np.ndarray, values: np.ndarray):
        self.cells, self.values = cells, values
        self.place = {tuple(c): i for i, c in enumerate(cells.tolist())}

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Tile:
        wide = rows.pivot_table(index="member", columns=["row", "col"], values="value").sort_index().sort_index(axis=1)
        if wide.isna().to_numpy().any():
            raise ValueError("[Tile] a member lacks a value at a cell")
        return cls(np.array([list(c) for c in wide.columns], dtype=int), wide.to_numpy())

    def step(self, tile, ms: int, obs: pd.DataFrame, radius: float | None, seed: int | None) -> pd.DataFrame:
        """The observations of one time, all at once, and what the tile is then. Those without a value or off the tile
        move nothing. The order in which they arrived doesn't matter. Without a seed they aren't perturbed."""
        known = obs[obs["observed"].notna()].sort_values(["row", "col", "observed", "sd"])
        known = known[[(r, c) in self.place for r, c in zip(known["row"], known["col"], strict=True)]]
        if len(known):
            at = np.array([self.place[r, c] for r, c in zip(known["row"], known["col"], strict=True)])
            sd = known["sd"].to_numpy(float)
            noise = np.zeros((len(self.values), len(at)))
            if seed is not None:
                noise = np.random.default_rng([seed, zlib.crc32(str(tile).encode()), ms]).normal(size=noise.shape) * sd
            self.values = moved(self.values, self.cells, at, known["observed"].to_numpy(float), sd, radius, noise)
        return pd.DataFrame(
            {"tile": [tile] * len(self.cells), "t": [pd.Timestamp(ms, unit="ms")] * len(self.cells), "row": self.cells[:, 0].astype("int32"), "col": self.cells[:, 1].astype("int32"),
             "mean": self.values.mean(axis=0), "sd": self.values.std(axis=0, ddof=1), "n_obs": np.full(len(self.cells), len(known), dtype="int32")}
        )


def _ms(t) -> int:
    return int(round(pd.Timestamp(t).timestamp() * 1000))


class TileProcessor(StatefulProcessor):
    """State of a tile: its ensemble, and the observations whose time the watermark hasn't passed. A timer for each time
    applies them then, so that those that come late but within the watermark take part in their own step."""

    def __init__(self, radius: float | None, seed: int | None):
        self.radius, self.seed = radius, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ensemble = handle.getValueState("ensemble", "rows array<int>, cols array<int>, values array<double>")
        self.waiting = handle.getMapState("waiting", "ms long", "obs array<struct<row:int,col:int,observed:double,sd:double>>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._keep(Tile.of(initialState))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for ms, part in pdf.groupby(pdf["t"].map(_ms)):
                new = [(int(r.row), int(r.col), float(r.observed), float(r.sd)) if pd.notna(r.observed) else (int(r.row), int(r.col), None, None) for r in part.itertuples()]
                at = (int(ms),)
                held = [tuple(o) for o in self.waiting.getValue(at)[0]] if self.waiting.containsKey(at) else []
                self.waiting.updateValue(at, (held + new,))
                if not held:
                    self.handle.registerTimer(int(ms) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = expiredTimerInfo.getExpiryTimeInMs() - 1
        obs = pd.DataFrame([tuple(o) for o in self.waiting.getValue((ms,))[0]], columns=["row", "col", "observed", "sd"])
        self.waiting.removeKey((ms,))
        if not self.ensemble.exists():
            return
        rows, cols, values = self.ensemble.get()
        tile = Tile(np.column_stack([rows, cols]).astype(int), np.array(values, float).reshape(-1, len(rows)))
        out = tile.step(key[0], ms, obs, self.radius, self.seed)
        self._keep(tile)
        yield out

    def _keep(self, tile: Tile) -> None:
        self.ensemble.update((tile.cells[:, 0].tolist(), tile.cells[:, 1].tolist(), tile.values.ravel().tolist()))

    def close(self) -> None:
        pass


def stream_tiles(observations: DataFrame, ensemble: DataFrame, late: str = "1 hour", radius: float | None = None, seed: int | None = 1) -> DataFrame:
    """tile, t, row, col, mean, sd, n_obs after each time at which a tile was observed; a stream.

    observations: a stream (tile, t timestamp, row, col, observed, sd); ensemble: the first state (tile, member, row,
    col, value). A tile's observations of a time wait until the watermark (the largest time seen, less `late`) has
    passed it and move the tile together, in the order of their times, however they arrived; what comes later still is
    dropped. Tiles are independent: covariances don't cross their borders, so that the state of a key is one tile. A row
    without a value only moves time on. Tiles without an ensemble give nothing.

    The session's state store must be RocksDB (STORE). After a restart the state and the timers go on from the checkpoint.
    """
    kind = dict(observations.dtypes)["tile"]
    cast = {"row": "int", "col": "int", "observed": "double", "sd": "double"}
    obs = observations.select("tile", F.col("t").cast("timestamp").alias("t"), *[F.col(c).cast(k).alias(c) for c, k in cast.items()]).withWatermark("t", late)
    first = ensemble.select("tile", F.col("member").cast("int").alias("member"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    return obs.groupBy("tile").transformWithStateInPandas(TileProcessor(radius, seed), STEP.format(kind=kind), "Append", "EventTime", first.groupBy("tile"))


def batch_tiles(observations: DataFrame, ensemble: DataFrame, radius: float | None = None, seed: int | None = 1) -> DataFrame:
    """What stream_tiles gives once it has seen all observations, from a table of them: a tile is a group, its times go
    in order."""

    def run(key: tuple, first: pd.DataFrame, obs: pd.DataFrame) -> pd.DataFrame:
        if not len(first) or not len(obs):
            return pd.DataFrame(columns=["tile", "t", "row", "col", "mean", "sd", "n_obs"])
        tile = Tile.of(first)
        return pd.concat([tile.step(key[0], ms, part, radius, seed) for ms, part in obs.groupby(obs["t"].map(_ms))])

    obs = observations.withColumn("t", F.col("t").cast("timestamp"))
    return ensemble.groupBy("tile").cogroup(obs.groupBy("tile")).applyInPandas(run, STEP.format(kind=dict(observations.dtypes)["tile"]))
