from sensorframe.sources.csv_runs import read_runs, stack_runs
from sensorframe.sources.sinks import write_table
from sensorframe.sources.tables import event_channels, event_runs, with_hours_left

__all__ = ["event_channels", "event_runs", "read_runs", "stack_runs", "with_hours_left", "write_table"]
