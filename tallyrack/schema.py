"""Table schemas: samples in long form, jobs, metrics and process rows."""

from __future__ import annotations

SAMPLE = "time timestamp, host string, jid string, type string, dev string, event string, unit string, value double, delta double, arc double"
SAMPLE_KEY = ("time", "host", "type", "event", "dev")
JOB = (
    "jid string, submit_time timestamp, start_time timestamp, end_time timestamp, runtime double, timelimit double, node_hrs double, nhosts int, "
    "ncores int, username string, account string, queue string, state string, qos string, jobname string, host_list array<string>"
)
METRIC = "jid string, type string, metric string, units string, value double, no_data_reason string"
#: Process counters; the first five keep their highest value when rows are merged.
PROC_PEAKS = ("vm_peak", "vm_hwm", "vm_stk", "vm_exe", "vm_lib")
PROC_LAST = ("uid", "vm_size", "vm_lck", "vm_rss", "vm_data", "vm_pte", "vm_swap", "threads")
PROC = "jid string, host string, proc string, device string, " + ", ".join(f"{c} bigint" for c in (*PROC_PEAKS, *PROC_LAST))
