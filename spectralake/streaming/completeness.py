"""Which shots of a stream are complete: distinct image rows held as state, dropped when done.

Two stateful steps. The first holds, for one frame, a bitmap of the image rows that have
come, and hands the frame on once when all are there; a hot shot is spread by frame. The
second holds the frames of a shot that are complete and hands the shot on once. Rows that
come again change neither. What is done keeps a mark of one byte instead of its state, for
``keep_ms``, then nothing; a frame or shot that stays incomplete for so long without a new
row is forgotten, too. Rows outside the frame's or shot's size are ignored. Time is that
of the batch a row comes in, so no row is ever late; it moves on with new rows only.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from spectralake.storage import attach

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP_MS = 7 * 24 * 3600 * 1000


def arrived(number, of, further, keep_ms):
    """A stateful step: the distinct ``number`` of a key as a bitmap; hands the key on when all below ``of`` have come.

    Its class is made here, so that it travels whole to workers without this package.
    """
    class Arrived(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.seen = handle.getValueState("seen", "bits binary")
            self.done = handle.getValueState("done", "mark boolean")

        def handleInputRows(self, key, rows, timerValues):
            finished = self.done.exists()
            bits = bytearray(self.seen.get()[0]) if not finished and self.seen.exists() else bytearray()
            size, last, new = 0, None, 0
            for frame in rows:
                last, size = frame.iloc[-1], int(frame[of].iloc[0])
                if finished:
                    continue
                bits.extend(bytes(max(0, -(-size // 8) - len(bits))))
                for i in frame[number].dropna().astype("int64").unique():
                    if 0 <= i < size and not bits[i >> 3] >> (i & 7) & 1:
                        bits[i >> 3] |= 1 << (i & 7)
                        new += 1
            if finished or not (new or not self.seen.exists()):
                return
            time = last["arrived"]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(time.timestamp() * 1000) + keep_ms)
            if sum(map(int.bit_count, bits)) < size:
                self.seen.update((bytes(bits),))
                return
            self.seen.clear()
            self.done.update((True,))
            yield pd.DataFrame([[*key, *(int(last[c]) for c in further), time]])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.seen.clear()
            self.done.clear()
            return iter(())

        def close(self):
            pass

    return Arrived()


def complete_frames(arrivals, keep_ms=KEEP_MS):
    """(shot, frame, n_frames, arrived) of each frame as its last row comes.

    ``arrivals`` is (shot, frame, y, n_frames, height, arrived), the last of them with a watermark.
    """
    step = arrived("y", "height", ["n_frames"], keep_ms)
    return arrivals.groupBy("shot", "frame").transformWithStateInPandas(
        step, "shot long, frame long, n_frames long, arrived timestamp", "Append", "EventTime", eventTimeColumnName="arrived")


def complete_shots(arrivals, expected, keep_ms=KEEP_MS):
    """(shot, n_frames, arrived) of each shot as its last frame becomes complete.

    ``arrivals`` is a stream of (shot, frame, y); ``expected`` is (shot, n_frames, height), saved.
    Shots that it does not list are never complete.
    """
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    sized = attach(arrivals.select("shot", "frame", "y"), expected.select("shot", "n_frames", "height"), ["shot"])
    inside = sized.where(F.col("frame").between(0, F.col("n_frames") - 1))
    timed = inside.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    step = arrived("frame", "n_frames", ["n_frames"], keep_ms)
    return complete_frames(timed, keep_ms).groupBy("shot").transformWithStateInPandas(
        step, "shot long, n_frames long, arrived timestamp", "Append", "EventTime")
