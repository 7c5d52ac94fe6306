"""A folder with bad files: batch and stream take the same rows and quarantine the same lines."""

import json
import os

from runlens.plans.session import checkpoint_path
from runlens.sources import ingest as I
from runlens.sources import json_files as JF
from runlens.sources.versioned import Store
from runlens.streaming import live as L


def delivery(i, run, action="completed", conclusion="success", **more):
    run = {"id": run, "status": "completed", "conclusion": conclusion, "created_at": f"2024-01-05T10:00:0{i % 10}Z", "updated_at": None}
    return json.dumps({"delivery_id": i, "event_type": "workflow_run",
                       "payload": {"action": action, "workflow_run": run, "repository": {"full_name": f"org/r{i}"}}, **more})


FILES = {
    "a.json": [delivery(1, 7), "", delivery(2, 7, conclusion="failure"), "{cut off", delivery(3, 8, action="requested")],
    "b.json": [],
    "c.json": ["[1, 2]", '{"delivery_id": "x", "event_type": "push", "payload": {}}', '{"event_type": "push", "payload": {}}',
               '{"delivery_id": 9, "event_type": "push"}', "null"],
    "d.json": [delivery(5, 9, extra={"k": [1]}), "plain text", delivery(4, 9, conclusion=None)],
}


def test_batch_equals_stream(spark, tmp_path):
    for name, lines in FILES.items():
        (tmp_path / name).write_text("\n".join(lines))
    batch = JF.read_deliveries(spark, str(tmp_path)).persist()
    store = Store(spark, checkpoint_path(spark, f"json-{os.getpid()}"))
    JF.runs_from_files(JF.stream_deliveries(spark, str(tmp_path)), store, checkpoint_path(spark, f"json-ckpt-{os.getpid()}")).awaitTermination()
    bad = lambda df: sorted((r.file, r.reason, r.record or "") for r in df.collect())
    assert bad(store.read("quarantine")) == bad(JF.quarantined(batch))
    assert {(f, r) for f, r, _ in bad(JF.quarantined(batch))} == {
        ("a.json", "not json"), ("c.json", "not json"), ("c.json", "no delivery id"), ("c.json", "no payload"), ("d.json", "not json")}
    assert ("a.json", "not json", "{cut off") in bad(JF.quarantined(batch))
    assert sorted(r.delivery_id for r in JF.usable(batch).collect()) == [1, 2, 3, 4, 5]
    got = {r.run_id: (r.repo, r.conclusion) for r in L.runs(store).collect()}
    assert got == {"7": ("org/r1", "failure"), "9": ("org/r4", "success")}
    assert I.webhook_ingest(JF.usable(batch)).where("outcome = 'received'").count() == 4
