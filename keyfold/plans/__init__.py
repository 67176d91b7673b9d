"""From command logs to state: the catalog of commands, the ordered fold, replay, and the keyspace tables."""
