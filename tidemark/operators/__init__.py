"""Tables in, tables out: profiles, signatures, lineage, causes, history, calibration."""
