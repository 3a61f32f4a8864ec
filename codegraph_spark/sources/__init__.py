"""Readers of source code: the frontends, and versions of files from git."""
