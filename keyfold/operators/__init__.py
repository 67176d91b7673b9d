"""Commands as relational operators: every function works on all keys of its input at once.

Logs have the columns `key` and `seq` (the order of commands) and what the command needs besides.
State has one row for each element: strings (key, value), hashes (key, field, value), lists (key, pos,
value), sets (key, member), zsets (key, member, score), documents (key, doc). Expiry is a column
`expires_at_ms`, and `now_ms` is always an argument, so results can be repeated.
"""
