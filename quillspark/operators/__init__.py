"""DataFrame operators over tables of documents."""
