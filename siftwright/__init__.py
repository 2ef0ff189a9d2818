"""siftwright: a PySpark-native engine over chat-assistant histories.

Everything is a function from DataFrames to DataFrames; nothing here needs a
service, a network or a machine-local folder.
"""
