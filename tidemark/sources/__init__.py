"""Where files come from: tables, directory trees, git, archives."""
