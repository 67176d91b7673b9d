"""Reading and writing keyspaces and command logs."""
