"""Sources and sinks: adapters over the driver tables, readers and writers of runs."""
