"""Schemas of every table, never inferred. IPv4 addresses are numbers, 0 where there is none."""

FRAMES = "file string, seq long, ts timestamp, orig_len int, link_type int, data binary"
DATAGRAMS = "datagram_id long, recv_ts timestamp, exporter_ip long, port int, payload binary"
TEMPLATE_FIELDS = "array<struct<ie:int,len:int,enterprise:boolean>>"
FLOW_LOGS = (
    "event_date date, isp_id int, device_id int, src_ip long, src_port int, dst_ip long, dst_port int, nat_public_ip long, nat_public_port int, "
    "protocol int, bytes long, packets long, flow_start timestamp, flow_end timestamp, flow_type string, exporter_ip long, created_at timestamp"
)
DEVICES = (
    "id long, isp_id int, name string, exporter_ip long, device_id int, protocol string, profile string, capture_policy string, "
    "enabled boolean, skip_dns boolean, skip_private boolean, skip_zero boolean"
)
POLICIES = "id long, isp_id int, name string, skip_dns boolean, skip_private boolean, skip_zero boolean"
ARCHIVED_DAYS = "day date, objects int, rows long, bytes long, archived_at timestamp"
QUERY_AUDIT = "id long, user_email string, isp_id int, query_ip string, query_port int, query_proto string, from_ts timestamp, to_ts timestamp, result_count int, case_ref string, created_at timestamp"
#: The columns of the cold archive beside its partition columns, addresses as dotted text.
COLD = (
    "device_id int, src_ip string, src_port int, dst_ip string, dst_port int, nat_public_ip string, nat_public_port int, "
    "protocol int, bytes long, packets long, flow_start string, flow_end string, flow_type string, exporter_ip string"
)
REGISTRY_BUNDLE = f"version string, unknown_mode string, devices array<struct<{', '.join(':'.join(c.strip().split(' ')) for c in DEVICES.split(','))}>>"
FLOW_KEY = ["isp_id", "device_id", "flow_start", "src_ip", "src_port", "dst_ip", "dst_port"]
