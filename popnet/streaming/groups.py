"""Results by target group, a bounded number of groups ahead of the consumer.

A producer thread runs each group's job in one job group and stores its rows, while the
consumer has the group before.  It starts a group only when fewer than ``ahead`` finished or
running ones wait to be taken, so storage and running work are bounded.  Closing the results
cancels the running job, waits for the thread and deletes what nobody took.
"""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from popnet.storage import released, written


class GroupResults:
    """An iterator of (group, rows) in the order of ``groups``, to be closed or used as a context.

    ``fit`` gives a group's rows; they are stored before they are handed out, and deleted when
    the next group is asked for.  An error in a group's job is raised in that group's place,
    and ends the results.
    """

    def __init__(self, spark: SparkSession, groups: Sequence[str], fit: Callable[[str], DataFrame], ahead: int = 1) -> None:
        if ahead < 1:
            raise ValueError("at least one group must be ahead")
        self._spark, self._groups, self._fit, self._ahead = spark, list(groups), fit, ahead
        self._job = f"popnet-groups-{uuid.uuid4().hex}"
        self._state = threading.Condition()
        self._ready: deque[tuple[str, DataFrame | None, BaseException | None]] = deque()
        self._running, self._stopped, self._taken = 0, False, None
        self._thread = InheritableThread(target=self._produce, daemon=True)
        self._thread.start()

    def _produce(self) -> None:
        self._spark.sparkContext.setJobGroup(self._job, "results by target group", True)
        for group in self._groups:
            with self._state:
                self._state.wait_for(lambda: self._stopped or len(self._ready) < self._ahead)
                if self._stopped:
                    return
                self._running = 1
            rows, error = None, None
            try:
                rows = written(self._fit(group), "group-results")
            except BaseException as e:  # the consumer raises it
                error = e
            with self._state:
                self._running = 0
                self._ready.append((group, rows, error))
                self._state.notify_all()
                if error is not None:
                    return

    def __iter__(self) -> Iterator[tuple[str, DataFrame]]:
        for _ in self._groups:
            with self._state:
                self._state.wait_for(lambda: self._ready or self._stopped)
                if self._stopped:
                    return
                group, rows, error = self._ready.popleft()
                self._state.notify_all()
            self._drop()
            if error is not None:
                self.close()
                raise error
            self._taken = rows
            yield group, rows
        self.close()

    def _drop(self) -> None:
        if self._taken is not None:
            released(self._taken)
            self._taken = None

    def close(self) -> None:
        """Stop: cancel the running job, wait for the thread and delete all stored rows."""
        with self._state:
            self._stopped = True
            self._state.notify_all()
        while self._thread.is_alive():  # a job may start just as the others are cancelled
            self._spark.sparkContext.cancelJobGroup(self._job)
            self._thread.join(0.2)
        self._drop()
        for _, rows, _ in self._ready:
            if rows is not None:
                released(rows)
        self._ready.clear()

    def __enter__(self) -> GroupResults:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
