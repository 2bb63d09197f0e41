"""A ledger of address lookups, shared by all jobs that spend one daily allowance.

Before a job asks anything it reserves the addresses: it writes them to a folder and publishes a numbered reservation that
names the folder and the calls it may cost. Of two jobs that publish the same number one succeeds; the other reads the
ledger again and chooses among what is left. So reservations never add up to more than the allowance, and no
address is in two of them. While it asks, each task notes an address in a journal before the call and its answer after it. A task or job
that runs again takes noted answers from there, and an address that was asked without an answer is not asked again.

The journal has one small file for each address, as many at most as the allowance. It is written by the executors through
pyarrow, so the folder must have an address that both Spark and pyarrow can open. Speculative
copies of a task would ask at the same time: leave ``spark.speculation`` off in jobs that look up.
On stores without an atomic rename, one job at a time may reserve.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .compaction import _files, _names

ADDRESSES = "IP string"


@dataclass(frozen=True)
class Reservation:
    """Addresses that one job alone may ask about.

    calls: what it counts for in the day's allowance.
    folder: the addresses, as Parquet with a column IP.
    """

    number: int
    job: str
    calls: int
    folder: str


def _day(path: str, day: date) -> str:
    return f"{path.rstrip('/')}/day={day:%Y-%m-%d}"


def journal_of(path: str, day: date) -> str:
    return f"{_day(path, day)}/journal"


def _publish(spark: SparkSession, target: str, text: str) -> bool:
    """Write a file that must not be there yet, as a whole; False if it is."""
    files, as_path = _files(spark, target)
    draft = as_path(f"{target.rsplit('/', 1)[0]}/draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if files.getScheme() == "file":
            # A local rename replaces what is there, a hard link does not.
            os.link(draft.toUri().getPath(), as_path(target).toUri().getPath())
            return True
        return not files.exists(as_path(target)) and files.rename(draft, as_path(target))
    except FileExistsError:
        return False
    finally:
        files.delete(draft, False)


def reservations(spark: SparkSession, path: str, day: date) -> list[Reservation]:
    """All reservations of a day, in order."""
    folder = _day(path, day)
    names = sorted(n for n in _names(spark, folder) if n.startswith("reservation-"))
    if not names:
        return []
    rows = spark.read.text([f"{folder}/{n}" for n in names], wholetext=True).collect()
    found = [Reservation(**json.loads(r["value"])) for r in rows]
    return sorted(found, key=lambda r: r.number)


def reserved(spark: SparkSession, some: list[Reservation]) -> DataFrame:
    """The addresses of some reservations, as column IP."""
    if not some:
        return spark.createDataFrame([], ADDRESSES)
    return spark.read.schema(ADDRESSES).parquet(*[r.folder for r in some])


def calls_left(spark: SparkSession, path: str, day: date, per_day: int) -> int:
    """What reservations have left of the allowance of a day."""
    return max(per_day - sum(r.calls for r in reservations(spark, path, day)), 0)


def reserve(
    spark: SparkSession,
    path: str,
    day: date,
    job: str,
    choose: Callable[[DataFrame, int], DataFrame],
    per_day: int,
    calls_each: int = 1,
) -> Reservation | None:
    """Reserve addresses for a job; None where nothing is wanted or left.

    ``choose`` gets the addresses already reserved that day and how many may be reserved at most,
    and gives a frame with a column IP: different addresses, none of those reserved, not more than that. It
    is called again whenever another job has reserved meanwhile. An address counts for ``calls_each`` calls.
    """
    while True:
        before = reservations(spark, path, day)
        most = max(per_day - sum(r.calls for r in before), 0) // calls_each
        if most == 0:
            return None
        folder = f"{_day(path, day)}/addresses-{uuid.uuid4().hex}"
        choose(reserved(spark, before), most).select("IP").coalesce(1).write.parquet(folder)
        wanted = spark.read.schema(ADDRESSES).parquet(folder).count()
        if wanted > most:
            raise ValueError(f"{wanted} addresses chosen, {most} left")
        new = Reservation(len(before) + 1, job, wanted * calls_each, folder)
        if wanted and _publish(spark, f"{_day(path, day)}/reservation-{new.number:06d}.json", json.dumps(vars(new))):
            return new
        files, as_path = _files(spark, folder)
        files.delete(as_path(folder), True)
        if not wanted:
            return None


def settle(spark: SparkSession, path: str, day: date, reservation: Reservation) -> None:
    """Note that all answers of a reservation are stored."""
    _publish(spark, f"{_day(path, day)}/done-{reservation.number:06d}", "")


def unsettled(spark: SparkSession, path: str, day: date, job: str) -> list[Reservation]:
    """The job's reservations that an earlier attempt has left unfinished."""
    done = {int(n[5:]) for n in _names(spark, _day(path, day)) if n.startswith("done-")}
    return [r for r in reservations(spark, path, day) if r.job == job and r.number not in done]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder by its address in Spark."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def journaled(
    provider: Callable[[str], dict[str, Any] | None],
    folder: str,
    tries: int = 1,
    wait: float = 1.0,
    per_second: float | None = None,
) -> Callable[[str], dict[str, Any] | None]:
    """A provider that notes what it asks and is answered, and asks about no noted address.

    A call that fails is repeated up to ``tries`` calls, after ``wait`` seconds, then twice as long
    each time; the last failure is raised. ``per_second`` bounds the calls of each task.
    """
    last = [0.0]

    def call(ip: str) -> dict[str, Any] | None:
        for left in range(tries - 1, -1, -1):
            if per_second:
                time.sleep(max(0.0, last[0] + 1 / per_second - time.monotonic()))
                last[0] = time.monotonic()
            try:
                return provider(ip)
            except Exception:
                if not left:
                    raise
                time.sleep(wait * 2 ** (tries - 1 - left))

    def ask(ip: str) -> dict[str, Any] | None:
        files, root = _open(folder)
        name = f"{root}/{hashlib.sha256(ip.encode()).hexdigest()}.json"
        if files.get_file_info(name).type == fs.FileType.File:
            with files.open_input_stream(name) as noted:
                text = noted.read().decode(errors="replace")
            try:
                return json.loads(text)["answer"] if text else None
            except ValueError:  # cut off while it was written
                return None
        files.create_dir(root, recursive=True)
        with files.open_output_stream(name):
            pass
        answer = call(ip)
        with files.open_output_stream(name) as noted:
            noted.write(json.dumps({"ip": ip, "answer": answer}, default=str).encode())
        return answer

    return ask
