"""rowsense: Spark jobs for grounding, checking and evaluating measurement rows and notes."""
