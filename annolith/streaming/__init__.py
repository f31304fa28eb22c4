"""Nothing streams here: every job reads a finite folder or table.  The package is kept so that a streaming source has a place."""
