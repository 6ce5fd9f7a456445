"""Submit independent driver-side steps concurrently.

Each step is a set of Spark jobs; running steps from separate threads lets
the scheduler overlap small jobs (Spark's job scheduling is thread-safe).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

PARALLEL_JOBS = 4


def run_parallel(tasks: dict, workers: int = PARALLEL_JOBS) -> dict:
    if workers <= 1 or len(tasks) <= 1:
        return {k: f() for k, f in tasks.items()}
    with ThreadPoolExecutor(max_workers=min(workers, len(tasks))) as ex:
        futs = {k: ex.submit(f) for k, f in tasks.items()}
        return {k: fu.result() for k, fu in futs.items()}
