"""Bringing a repository in: the steps, their order and what is said of them. The steps themselves are given by the caller."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from symgrid.functions.scalars import parse_repo_url

#: Steps with the progress at which each begins.
STEPS = {"cloning": 10, "indexing": 35, "exporting": 65, "enriching": 80}


def repo_id_of(repo: str, ref: str | None) -> str:
    """``repo@ref``; HEAD without a ref, twelve characters of a full commit."""
    ref = ref or "HEAD"
    return f"{repo}@{ref[:12] if len(ref) == 40 else ref}"


class Importer:
    """Runs imports in the background. ``steps`` has a function of (owner, repo, ref, repo_id) for each of ``STEPS``.

    queued, then each step, then done; error with its message if a step fails, but for enriching, whose failure is only
    noted, since the snapshot can be used without it.
    """

    def __init__(self, steps: dict[str, Callable[[str, str, str | None, str], None]]) -> None:
        self.steps, self._jobs, self._threads = steps, {}, {}

    def start(self, url: str) -> str:
        """Number of the job; raises for an address that names no repository."""
        parts = parse_repo_url(url)
        if not parts:
            raise ValueError(f"no address of a repository: {url}")
        job = uuid.uuid4().hex[:8]
        repo_id = repo_id_of(parts["repo"], parts.get("ref"))
        self._jobs[job] = {"status": "queued", "message": "", "progress": 0, "repo_id": repo_id}
        self._threads[job] = threading.Thread(target=self._run, args=(job, parts, repo_id), daemon=True)
        self._threads[job].start()
        return job

    def _run(self, job: str, parts: dict[str, str], repo_id: str) -> None:
        state = self._jobs[job]
        for step, progress in STEPS.items():
            state.update(status=step, progress=progress)
            try:
                self.steps[step](parts["owner"], parts["repo"], parts.get("ref"), repo_id)
            except Exception as e:
                if step != "enriching":
                    state.update(status="error", message=str(e))
                    return
                state["warning"] = str(e)[-200:]
        state.update(status="done", progress=100)

    def wait(self, job: str, seconds: float | None = None) -> dict:
        self._threads[job].join(seconds)
        return self.status(job)

    def status(self, job: str) -> dict:
        return {"job_id": job, **self._jobs[job]} if job in self._jobs else {"status": "not_found"}
