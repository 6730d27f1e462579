"""DataFrame operators: ranking, graph, files, knowledge base, index maintenance, events."""
