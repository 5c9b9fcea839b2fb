"""tidewire: message-stream analytics on PySpark."""
