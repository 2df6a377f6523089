"""Where results go: rendered texts, JSON, keyed comments, exit codes."""
